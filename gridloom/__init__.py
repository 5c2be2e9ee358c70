"""gridloom: raster, cell and zone analytics as Spark DataFrame jobs."""
