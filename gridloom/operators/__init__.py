"""DataFrame operators: folds, fills, joins, class analytics, terrain, heat and regions."""
