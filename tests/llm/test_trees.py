"""Jaccard join, manifest and prefix trie against plain versions, and on awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_ops import AWKWARD, SCHEMA, awkward, edited, frame, near_plain, prose, templates  # noqa: F401

from gridloom.llm import count_tree, manifest, near_dup, prefix_trie, queries

SF = "/root/testdata/sf0.01"


# Jaccard join


def links_of(spark, texts, **more):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in count_tree.jaccard_components(frame(spark, texts), **more).collect()}


def joined_plain(rows, percent=85):
    return near_plain(rows, percent, width=4)


@pytest.mark.parametrize("percent", [85, 80])
def test_join_equals_brute_force(spark, monkeypatch, percent):
    """Chains, one large group, sets just above and below the bound, trees of several blocks and levels."""
    monkeypatch.setattr(count_tree, "BLOCK", 16)
    monkeypatch.setattr(count_tree, "LEAF", 2)
    rnd = random.Random(3)
    base = prose(9, 160).split()
    texts = [edited(base, rnd, rnd.choice([0.0, 0.005, 0.01, 0.02, 0.04])) for _ in range(120)]
    texts += [prose(i, 60) for i in range(20)] + ["Ab c", "ab C", "ab c d e f", None, "", " "]
    texts += [" ".join(f"v{i}" for i in range(n)) for n in range(3, 40)]
    assert links_of(spark, texts, percent=percent) == joined_plain(list(enumerate(texts)), percent)


def test_join_of_hub_and_spokes(spark, monkeypatch):
    """Copies that link with their source alone, not with each other; the source has not the smallest id."""
    monkeypatch.setattr(count_tree, "BLOCK", 16)
    rnd = random.Random(11)
    base = prose(71, 300, 5000).split()
    texts = []
    for k in range(90):
        w = list(base)
        for at in rnd.sample(range(5, 295), 6 if k else 0):
            w[at] = f"z{k}x{at}"
        texts.append(" ".join(w))
    texts = texts[40:] + texts[:40]
    got = links_of(spark, texts)
    assert got == joined_plain(list(enumerate(texts)))
    assert {c for _, c, _ in got.values()} == {0}


def test_join_of_given_documents(spark):
    """Every document of the small tables."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op11_jaccard_join(spark, SF).collect()}
    assert got == {d: (n, c) for d, (n, c, _) in joined_plain([(r.doc_id, r.text) for r in rows]).items()}


def test_awkward_documents_in_the_join(awkward):  # noqa: F811
    rows = awkward.select("doc_id", "text").collect()
    got = count_tree.jaccard_components(awkward).collect()
    assert len(got) == len(rows) and count_tree.jaccard_components(awkward.where("false")).count() == 0
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert {r.component_id for r in got if r.doc_id in (7, 8)} == {7}


def optional_pages(n, seed=0):
    """Pages of one template with 6 of 60 optional paragraphs: alike without a link."""
    rnd = random.Random(seed)
    paragraphs = [prose(1000 + k, 15, 10**6) for k in range(60)]
    common = prose(999, 150, 10**6)
    return [" ".join([common, *rnd.sample(paragraphs, 6)]) for _ in range(n)]


@pytest.mark.parametrize(("pages", "counts"), [(templates, (300, 600)), (optional_pages, (600, 1200))])
def test_points_sent_grow_in_proportion(spark, monkeypatch, pages, counts):
    searched, sent = count_tree.searched, {}

    def counting(rows, *rest):
        sent[n] = sent.get(n, 0) + rows.count()
        return searched(rows, *rest)

    monkeypatch.setattr(count_tree, "searched", counting)
    for n in counts:
        texts = pages(n)
        texts.append(texts[5] + " other")
        got = links_of(spark, texts)
        assert got == joined_plain(list(enumerate(texts)))
    assert sent[counts[1]] <= 2.3 * max(sent[counts[0]], 100)


def test_bounds_hold_and_trees_find_all_pairs():
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(260)]
    sets = []
    for _ in range(120):
        own = set(rnd.sample(base, rnd.randrange(180, 250))) | {rnd.getrandbits(64) for _ in range(rnd.randrange(40))}
        sets.append(count_tree.np.array(sorted(own), count_tree.U))
    sizes = count_tree.np.array([len(s) for s in sets])
    points = [count_tree.point(s) for s in sets]
    found = set(zip(*map(list, count_tree.bounded_pairs(points, sizes, points, sizes, 60)), strict=True))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(set(a.tolist()) & set(b.tolist()))
            assert (i, j) in found or 100 * common < 60 * (len(a) + len(b) - common)
    assert len(found) < len(sets) ** 2


def test_texts_of_template_pages_are_sent_in_proportion(spark, monkeypatch):
    """Pages with optional paragraphs in the MinHash operator: no more texts than in proportion, though all are candidates."""
    monkeypatch.setattr(near_dup, "BLOCK", 32)
    monkeypatch.setattr(near_dup, "PIVOTS", 4)
    monkeypatch.setattr(near_dup, "CENTRAL", 2)
    compared, verified, sent = near_dup.compared, count_tree.verified, {}

    def counting(rows, *rest):
        sent[n] = sent.get(n, 0) + rows.count()
        return compared(rows, *rest)

    def counting_pairs(pairs, *rest):
        sent[n] = sent.get(n, 0) + 2 * pairs.count()
        return verified(pairs, *rest)

    monkeypatch.setattr(near_dup, "compared", counting)
    monkeypatch.setattr(count_tree, "verified", counting_pairs)
    for n in (300, 600):
        texts = optional_pages(n)
        texts.append(texts[5] + " other")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
        assert got == near_plain(list(enumerate(texts)))
    assert sent[600] <= 2.4 * sent[300] and sent[600] < 3 * 600


# Manifest


def leaf_plain(values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def tree_plain(digests, fan):
    """(top, proofs) by definition: runs of `fan` become one until one is left."""
    proofs = [[] for _ in digests]
    owners = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        ups, up_owners = [], []
        for at in range(0, len(digests), fan):
            run = digests[at : at + fan]
            for k in range(len(run)):
                for leaf in owners[at + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            ups.append(hashlib.sha256("".join(run).encode()).hexdigest())
            up_owners.append([i for o in owners[at : at + fan] for i in o])
        digests, owners = ups, up_owners
    return digests[0], proofs


def manifest_plain(rows, fan=3):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, told = [], []
    for s in order:
        mine = sorted(((r, leaf_plain(r)) for r in by_source[s]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        top, proofs = tree_plain([d for _, d in mine], fan)
        tops.append(top)
        told.append([(*x, top, p) for x, p in zip(mine, proofs, strict=True)])
    if not tops:
        return []
    root, ups = tree_plain(tops, fan)
    out = []
    for group, up in zip(told, ups, strict=True):
        for r, d, top, p in group:
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf_plain((*r[:4], text))
            for left, right in p + up:
                now = hashlib.sha256((left + now + right).encode()).hexdigest()
            proof = hashlib.sha256("".join(a + b for a, b in p + up).encode()).hexdigest()
            out.append((r[0], d, top, root, proof, now, now == root))
    return out


key = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 9, None: 10, "é": 28, "Z": 1, "": 2}, {f"s{i}": 1 + i % 5 for i in range(11)}])
def test_manifest_equals_a_plain_version(spark, tmp_path, counts):
    rnd = random.Random(1)
    ids = iter(rnd.sample(range(-500, 5000), 400))
    rows = [(next(ids), rnd.choice([None, "line\nline", "é漢🙂", "", f"t {rnd.random()}\n"]), rnd.choice([None, "en"]), s, rnd.choice([None, 7])) for s, n in counts.items() for _ in range(n)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(manifest_plain([(d, s, la, n, t) for d, t, la, s, n in rows]), key=key)


def test_manifest_of_awkward_rows(awkward, spark, tmp_path):  # noqa: F811
    """Null and repeated ids, equal rows, columns with the operator's own names, an empty table, one row."""
    docs = awkward.unionByName(awkward.where("doc_id = 7")).withColumns({c: F.lit("own") for c in ("name", "lo", "hi", "digest", "leaf", "proof", "children")})
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = [tuple(r) for r in queries.op12_manifest(spark, f"{tmp_path}/a").collect()]
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert sorted(got, key=key) == sorted(manifest_plain(rows), key=key)
    docs.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op12_manifest(spark, f"{tmp_path}/b").count() == 0
    docs.where("doc_id = 3").write.parquet(f"{tmp_path}/c/documents.parquet")
    (one,) = queries.op12_manifest(spark, f"{tmp_path}/c").collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_other_fans_and_changed_leaves(spark):
    docs = frame(spark, [f"text {i}" for i in range(23)])
    listed = manifest.manifest(docs, manifest.digest(F.col("doc_id"), F.col("text")), fan=2).withColumn("folded", manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    assert {r.root for r in listed} == {tree_plain([leaf_plain((i, f"text {i}")) for i in range(23)], 2)[0]}
    assert all(r.folded == r.root for r in listed)


# Prefix trie


def rebuilt_plain(rows):
    """conv_id -> its turns (role, text) of rows (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t, r or "", x or ""))
    mark = lambda r, x: hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
    order = {c: [(r, x) for _, r, x in sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, mark(*t[1:])))] for c, v in turns.items()}
    out = {}
    for c in order:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = order.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + order[c][h:]
    return out


def trie_plain(convs):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        path = tuple(convs[c])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        listed = hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], listed))
    return sorted(out, key=key)


def trie_of(spark, convs):
    """The trie of conv_id -> turns as they are."""
    rows = [(c, [(hashlib.md5(repr(t).encode()).digest(), len(t[1])) for t in turns]) for c, turns in convs.items()]
    frame_ = spark.createDataFrame(rows, "conv_id long, turns array<struct<hash:binary,size:int>>").repartition(3)
    return sorted((tuple(r) for r in prefix_trie.trie(frame_).collect()), key=key)


def test_trie_of_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_prefix_trie(spark, SF).collect()), key=key)
    assert got == trie_plain(rebuilt_plain(rows))


@pytest.mark.parametrize("run", [3, 8192])
def test_trie_in_runs_of_any_size(spark, monkeypatch, run):
    """Families of copies, stairs of ever longer conversations, one long conversation, one first turn for most: with runs of
    three paths, nearly all nodes are left open again and again."""
    rnd = random.Random(8)
    if run == 3:
        monkeypatch.setattr(prefix_trie, "RUN", 8)
    turn = lambda k: ("user" if k % 2 else "", f"said {k}" * (k % 3))
    convs = {c: [turn(0), *[turn(rnd.randrange(3)) for _ in range(rnd.randrange(6))]] for c in range(150)}
    convs |= {1000 + c: [turn(k) for k in range(c)] for c in range(40)}
    convs |= {2000 + c: [turn(k % 7) for k in range(300)] + [turn(c)] for c in range(3)}
    convs |= {-c: [turn(1), turn(2)] for c in range(1, 30)} | {5000: []}
    assert trie_of(spark, convs) == trie_plain(convs)


def test_trie_over_many_runs(spark):
    """Runs whose last path begins like the first of the next: what the second holds of shorter prefixes counts too."""
    rnd = random.Random(4)
    convs = {c: [("u", "ab"[rnd.randrange(2)]) for _ in range(rnd.randrange(12))] for c in range(1500)}
    many = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got = trie_of(spark, convs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == trie_plain(convs)


def test_trie_of_awkward_turns(spark, tmp_path):
    """Null turns, roles, texts and ids, ties, repeated rows, absent heads, negative ids, columns with the operator's own names."""
    rows = [(c, t, r, x) for c in (0, 1, 2, 99, 100, 101, 250, -3, -150) for t, r, x in [(None, "user", "first"), (1, None, "é漢🙂"), (1, "user", None), (2, "a", "b"), (2, "a", "b"), (3, "", "")][: 6 - abs(c) % 5]]
    rows += [(None, 1, "user", "nobody"), (301, 1, "user", "alone"), (0, 9, "x", "y" * 100_000)]
    own = {c: F.lit("own") for c in ("path", "lens", "n", "least", "ends", "depth", "salt", "first", "h")}
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(own).write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = sorted((tuple(r) for r in queries.op13_prefix_trie(spark, f"{tmp_path}/a").collect()), key=key)
    assert got == trie_plain(rebuilt_plain(rows))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert queries.op13_prefix_trie(spark, f"{tmp_path}/b").count() == 0


def test_role_and_text_are_told_apart(spark, tmp_path):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = prefix_trie.trie(prefix_trie.sequences(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).where("depth = 1")
    assert found.count() == 3


@pytest.mark.parametrize("name", ["op12_manifest", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    expected = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, expected), key=key)
