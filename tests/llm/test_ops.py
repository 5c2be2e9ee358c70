"""The text operators on awkward rows and against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from gridloom.llm import bpe_codec, components, lang_id, media, mixing, near_dup, pii, quality_model, quality_rules, queries, repeats, token_counts
from gridloom.llm.base import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [None, "", " ", "\n\n\t", "a", "é漢🙂 ﬁ", "x" * 5000, "same text twice", "same text twice", "<s>▁▁ <|endoftext|>", "a\x0bb\x0cc d e", "don't 's 123abc!?  \n x"]


def frame(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", "en"), columns.get("source", "s"), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty and long texts, repeated rows, an extra column with a name that operators use."""
    rows = [(i, t, "en", "s", 1, "extra") for i, t in enumerate(AWKWARD)] + [(None, None, None, None, None, None), (7, "same text twice", None, None, None, None), (7, "same text twice", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA + ", size string").withColumns({"keys": F.lit("x"), "ids": F.lit(1), "n": F.lit(2)})


OPERATORS = {
    "lang": lambda d: lang_id.identify(d, lang_id.fit(d)),
    "pii": lambda d: pii.surrogate_texts(d, b"k"),
    "grades": lambda d: quality_model.graded(d, quality_model.fit(d, d.select("doc_id", (F.col("doc_id") % 3).alias("grade")))),
    "repeats": lambda d: repeats.repeated_spans(d),
    "counts": lambda d: token_counts.token_counts(d, public_tokenizers.path(queries.PIECE_MODEL)),
    "media": lambda d: media.decode(media.encode(d)),
    "mixing": lambda d: mixing.systematic_copies(d),
    "bpe": lambda d: bpe_codec.decode(bpe_codec.encode(d, public_tokenizers.path(queries.RANK_FILE), public_tokenizers.PATTERN), public_tokenizers.path(queries.RANK_FILE), public_tokenizers.PATTERN),
    "rules": lambda d: quality_rules.quality_rules(d),
    "near": lambda d: near_dup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_tables(awkward, name):
    got = OPERATORS[name](awkward)
    assert name == "repeats" or got.count() == awkward.count()
    assert OPERATORS[name](awkward.where("false")).count() == 0


MADE = "lang_pred score margin rejected entities expected_grade tails selected n_tokens media payload height width rgb features size source_size target copies ids decoded n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed symbols_high kept counted own key step cell rank n_shingles component_id row start other fence_lang".split()


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_with_clashing_names(spark, name):
    docs = frame(spark, [prose(1, 60), None, "", prose(1, 60)]).withColumns({c: F.lit(f"own {c}") for c in MADE})
    got = OPERATORS[name](docs) if name != "mixing" else mixing.systematic_copies(docs, carry=["size", "copies", "key", "lang"])
    rows = got.collect()
    handed = [c for c in got.columns if c.endswith("_before")]
    assert name == "repeats" or len(rows) == 4
    assert all(r[c] == f"own {c.removesuffix('_before')}" for r in rows for c in handed)
    expected = {"lang": 4, "pii": 1, "grades": 3, "counts": 1, "media": 6, "mixing": 2, "bpe": 2, "rules": 8}
    assert len(handed) == expected.get(name, 0)


def test_words_split_at_ascii_space_only(spark):
    got = [r.w for r in frame(spark, AWKWARD).orderBy("doc_id").select(words(F.col("text")).alias("w")).collect()]
    assert got == [WORD.findall(t or "") for t in AWKWARD]


def test_token_counts_equal_the_library(spark):
    rnd = random.Random(3)
    texts = AWKWARD + ["".join(rnd.choice("abcdeing  \n\t▁<s>019éñ漢🙂'") for _ in range(rnd.randint(1, 300))) for _ in range(300)] + ["ab" * 3000, "aaaa" * 700, " " * 333]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, texts), sp and public_tokenizers.path(queries.PIECE_MODEL)).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}


def test_long_texts_without_spaces_take_linear_time():
    path = public_tokenizers.path(queries.PIECE_MODEL)
    table, sp, rnd = token_counts.PieceTable(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(8)
    texts = ["ab" * 50_000, "a" * 100_000, "".join(rnd.choice("etaoinshrdlu") for _ in range(100_000)), "漢字" * 50_000]
    began = time.perf_counter()
    assert token_counts.count_texts(texts, table, {}) == [len(sp.encode(t)) for t in texts]
    assert time.perf_counter() - began < 20


def test_rank_lists_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 6)
    path = public_tokenizers.path(queries.PIECE_MODEL)
    table, sp, rnd = token_counts.PieceTable(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(9)
    texts = ["".join(rnd.choice("aab" if i % 2 else "abcdeing▁019éñ漢🙂'th") for _ in range(rnd.randint(7, 80))) for i in range(600)]
    assert token_counts.count_texts(texts, table, {}) == [len(sp.encode(t)) for t in texts]


def test_bpe_equals_the_library_also_where_cut(spark):
    path, pattern = public_tokenizers.path(queries.RANK_FILE), public_tokenizers.PATTERN
    enc = bpe_codec.encoding(path, pattern)
    assert isinstance(enc, tiktoken.Encoding)
    texts = [t for t in AWKWARD if t] + [prose(1, 900), "it's 12ab, isn't  it?\n\n  'sab's9" * 40]
    for t, limit in itertools.product(texts, (5, 17, 100)):
        assert bpe_codec.encode_text(t, enc, limit) == enc.encode_ordinary(t)
    df = bpe_codec.decode(bpe_codec.encode(frame(spark, AWKWARD), path, pattern, limit=50), path, pattern)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in df.collect())


def test_jpeg_round_trip_and_features_agree():
    for t in [*AWKWARD, prose(2, 3000)]:
        data = media.payload_of(t)
        assert len(data) % 192 == 0 and len(data) >= 192
        file = media.write_jpeg(data)
        jpeg = media.Jpeg(file)
        assert jpeg.payload() == data and file == media.write_jpeg(data)
        rgb = jpeg.rgb()
        assert rgb.shape == (jpeg.height, jpeg.width, 3) and media.features(rgb)[:2] == [jpeg.height, jpeg.width]


def rgb_plain(jpeg):
    """The pixels of a JPEG's coefficients by the transform's definition, one sample after the other."""
    import math

    zigzag = [x for s in range(15) for x in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), reverse=s % 2 == 0)]
    c = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    planes = []
    for coef, q, (h, v) in zip(jpeg.coefs, jpeg.uses, jpeg.sampling, strict=True):
        def sample(y, x, coef=coef, q=q, h=h, v=v):
            y, x = y * v // jpeg.most[1], x * h // jpeg.most[0]
            block, total = coef[y // 8, x // 8], 0.0
            for k, (row, col) in enumerate(zigzag):
                if block[k]:
                    total += c(row) * c(col) / 4 * block[k] * jpeg.quant[q][k] * math.cos((2 * (y % 8) + 1) * row * math.pi / 16) * math.cos((2 * (x % 8) + 1) * col * math.pi / 16)
            return min(255, max(0, math.floor(total + 0.5) + 128))

        planes.append(sample)
    out = {}
    for y in range(jpeg.height):
        for x in range(jpeg.width):
            luma, cb, cr = planes[0](y, x), planes[1](y, x) - 128, planes[2](y, x) - 128
            out[y, x] = (luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb)
    return out


def test_jpeg_pixels_equal_a_plain_transform():
    jpeg = media.Jpeg(media.write_jpeg(media.payload_of(prose(4, 60))))
    rgb = jpeg.rgb()
    expected = rgb_plain(jpeg)
    assert rgb.shape == (jpeg.height, jpeg.width, 3)
    # coefficients of a payload are all large: the whole-number transform may differ by a step or two
    off = [abs(int(rgb[at][k]) - min(255, max(0, v))) for at, pixel in expected.items() for k, v in enumerate(pixel)]
    assert max(off) <= 3 and sum(off) / len(off) < 1
    assert media.features(rgb)[2:5] == [int(rgb[:, :, k].sum()) for k in range(3)]


def test_jpeg_general_scans():
    """Runs of zeros, ends of blocks over several blocks, and new values in a refining scan, written by hand."""
    head = media.HEAD + media._segment(0xC2, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00")
    table = lambda kind, codes: media._segment(0xC4, bytes([kind]) + bytes(len([c for c in codes if codes[c] == n]) for n in range(1, 17)) + bytes(sorted(codes, key=lambda c: (codes[c], list(codes).index(c)))))
    scan = lambda lo, hi, a, bits: media._segment(0xDA, bytes([1, 1, 0, lo, hi, a])) + media._closed(media.np.array(list(map(int, bits)), media.np.uint8))
    # two blocks; DC 3 and 3 + 1; AC of block 0: 0, 0, 2 then end; block 1: end
    tables = table(0x00, {0: 2, 1: 2, 2: 2}) + table(0x10, {0x21: 2, 0x00: 2, 0x10: 2, 0x01: 3})
    first = scan(0, 0, 0, "1011" + "011") + scan(1, 5, 1, "00" + "1" + "01" + "01")
    # refine: block 0 gets a new -1 at place 1 (symbol 0x01, sign 0) passing nothing, then both blocks end (run of 2: 0x10 + one bit), correction 1
    second = scan(1, 5, 0x10, "110" + "0" + "10" + "0" + "1")
    jpeg = media.Jpeg(head + tables + first + second + b"\xff\xd9")
    assert jpeg.coefs[0][0, 0, :6].tolist() == [3, -1, 0, 3, 0, 0] and jpeg.coefs[0][0, 1, :6].tolist() == [4, 0, 0, 0, 0, 0]
    assert jpeg.payload() is None and jpeg.rgb().shape == (8, 16, 3)
    with pytest.raises(ValueError):
        media.Jpeg(b"GIF89a")


def near_plain(rows, percent=85, width=5):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault(d, set())
        if w:
            sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def edited(words_, rnd, share):
    return " ".join(f"e{rnd.randrange(10**6)}" if rnd.random() < share else w for w in words_)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    """Chains and one group so large that it is cut into blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "PIVOTS", 3)
    rnd = random.Random(5)
    base = prose(9, 160).split()
    texts = [edited(base, rnd, rnd.choice([0.0, 0.005, 0.01, 0.02, 0.04])) for _ in range(120)]
    texts += [prose(i, 60) for i in range(20)] + ["Ab c", "ab C", "ab c d e f", None, "", " "]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    assert got == near_plain(list(enumerate(texts)))


def templates(n, seed=0):
    """Pages of one template: half of their words are the template's, so none links with another."""
    rnd = random.Random(seed)
    frame_ = prose(70, 150).split()
    return [" ".join([*frame_[:75], *(f"p{rnd.randrange(10**7)}" for _ in range(38)), *frame_[75:]]) for _ in range(n)]


def test_template_pages_are_sent_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 32)
    monkeypatch.setattr(near_dup, "PIVOTS", 4)
    monkeypatch.setattr(near_dup, "CENTRAL", 2)
    compared, sent = near_dup.compared, {}

    def counting(rows, *rest):
        sent[n] = sent.get(n, 0) + rows.count()
        return compared(rows, *rest)

    monkeypatch.setattr(near_dup, "compared", counting)
    for n in (300, 600):
        texts = templates(n)
        twin = texts[5].split()
        texts.append(" ".join([*twin[:60], "other", *twin[61:]]))
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
        assert got == {i: i for i in range(n)} | {n: 5}
    assert sent[600] <= 2.3 * sent[300]


def test_hub_and_spokes_equal_brute_force(spark, monkeypatch):
    """Copies that link with their source alone, not with each other."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "PIVOTS", 2)
    rnd = random.Random(11)
    base = prose(71, 300, 5000).split()
    texts = []
    for k in range(90):
        w = list(base)
        for at in rnd.sample(range(5, 295), 5 if k else 0):
            w[at] = f"z{k}x{at}"
        texts.append(" ".join(w))
    texts = texts[40:] + texts[:40]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    assert got == near_plain(list(enumerate(texts)))


@pytest.mark.parametrize("size", [1, 2, 7, 63, 64, 500])
def test_superminhash_of_few_elements_is_the_same(monkeypatch, size):
    rnd = random.Random(size)
    sets = [near_dup.np.array([rnd.getrandbits(64) for _ in range(size)], near_dup.U) for _ in range(3)]
    one = near_dup.signatures(sets, 48)
    monkeypatch.setattr(near_dup, "FEW", 0)
    assert (one == near_dup.signatures(sets, 48)).all()


def test_superminhash_estimates_similarity():
    rnd = random.Random(1)
    a = near_dup.np.array([rnd.getrandbits(64) for _ in range(900)], near_dup.U)
    b = near_dup.np.concatenate([a[:600], near_dup.np.array([rnd.getrandbits(64) for _ in range(300)], near_dup.U)])
    s = near_dup.signatures([a, b, a[:1]], 256)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.1 and sorted(map(int, s[2])) == list(range(256))


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (7, 6), (7, 6)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, 200: 200}


def repeats_plain(rows, least):
    seen, found = collections.defaultdict(set), {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d, w in split.items():
        for i in range(len(w) - least + 1):
            seen[tuple(w[i : i + least])].add(d)
    for d, w in split.items():
        hit = set()
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                hit.update(range(i, i + least))
        if hit:
            found[d] = hit
    return found


def test_repeated_spans_equal_brute_force(spark):
    passage, other = prose(77, 55).split(), prose(78, 90).split()
    texts = [prose(i, 100, 5000) for i in range(30)]
    for i in range(0, 20):
        w = texts[i].split()
        texts[i] = " ".join(w[: 3 * i] + passage + w[3 * i :] + (other if i % 3 == 0 else []))
    texts += [texts[0], prose(200, 49), None, "", " ".join(passage[:49]), "solo " * 300]
    rows = list(enumerate(texts))
    got = collections.defaultdict(set)
    for r in repeats.repeated_spans(frame(spark, texts)).collect():
        got[r.doc_id].update(range(r.start, r.stop))
        assert r.other != r.doc_id and r.n_words == len(texts[r.doc_id].split())
    assert dict(got) == repeats_plain(rows, 50)


def crowded():
    """A passage many times in each of two documents; passages of two documents each that end in a phrase all have."""
    line, phrase = prose(300, 50), prose(301, 12)
    texts = [" ".join([prose(302 + i, 30, 5000), *[line] * 20, prose(304 + i, 30, 5000)]) for i in range(2)]
    texts += ["Der " * 300 + prose(306 + i, 60, 5000) for i in range(2)]
    for i in range(120):
        texts += [" ".join([prose(400 + i, 45, 5000), phrase, prose(1000 + 2 * i + k, 60, 5000)]) for k in range(2)]
    return texts


@pytest.mark.parametrize("least", [50, 33])
def test_repeated_spans_of_crowded_keys(spark, least):
    texts = crowded()
    got = collections.defaultdict(set)
    for r in repeats.repeated_spans(frame(spark, texts), least=least).collect():
        got[r.doc_id].update(range(r.start, r.stop))
        assert r.other != r.doc_id
    assert dict(got) == repeats_plain(list(enumerate(texts)), least)


def led_in(pairs=40):
    """Pairs of documents that share 20 words of their own before a line of 35 words that all have."""
    line = prose(320, 35)
    return [" ".join([prose(500 + 2 * i + k, 40, 5000), prose(2000 + i, 20, 5000), line, prose(700 + 2 * i + k, 40, 5000)]) for i in range(pairs) for k in range(2)]


def test_repeated_spans_beside_a_common_line(spark):
    passage = prose(321, 60)
    texts = led_in() + [" ".join(x for k in range(8) for x in (passage, prose(3000 + k, 30, 5000))), prose(3100, 30, 5000) + " " + passage]
    got = collections.defaultdict(set)
    for r in repeats.repeated_spans(frame(spark, texts)).collect():
        got[r.doc_id].update(range(r.start, r.stop))
    assert len(got) == 82 and dict(got) == repeats_plain(list(enumerate(texts)), 50)


def test_repeats_of_negative_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SORTED", 3)
    passage = prose(322, 55)
    texts = [" ".join([prose(900 + i, 20, 5000), passage]) for i in range(4)]
    rows = [(i, t, "en", "s", 1) for i, t in zip((-5, -6, None, None), texts, strict=True)] + [(None, texts[3], "en", "s", 1), (-5, texts[0], "en", "s", 1)]
    got = sorted((r.doc_id or 0, r.start, r.stop) for r in repeats.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-6, 20, 75), (-5, 20, 75), (0, 20, 75), (0, 20, 75)]
    nameless = spark.createDataFrame(rows[2:5], SCHEMA)
    assert sorted((r.doc_id, r.start, r.other) for r in repeats.repeated_spans(nameless).collect()) == [(None, 20, None)] * 2


def test_repeats_inside_one_document(spark):
    texts = [" ".join([prose(310, 60, 5000), *[prose(311, 50)] * 9, prose(312, 60, 5000)]), prose(313, 200, 5000)]
    got = [(r.doc_id, r.start, r.stop) for r in repeats.repeated_spans(frame(spark, texts), within=True).collect()]
    assert got == [(0, 60, 510)]


def test_mixing_shares_caps_and_copies(spark):
    rows = [(i, prose(i, 5 + i % 40), "en", ("a", "b", "c", "d", None)[min(4, i % 7)], 0) for i in range(700)]
    got = mixing.systematic_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = {i: len(t.split()) for i, t, *_ in rows}
    total = sum(sizes.values())
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == sizes[r.doc_id] and 0 <= r.copies <= 2
        by[rows[r.doc_id][3]].append(r)
    assert sum(x[0].target for x in by.values()) == pytest.approx(1.5 * total)
    for x in by.values():
        target, source = x[0].target, sum(r["size"] for r in x)
        assert x[0].source_size == source and target <= 2 * source + 1e-9
        assert abs(sum(r.copies * r["size"] for r in x) - target) <= 0.05 * target
    again = sorted(map(tuple, mixing.systematic_copies(spark.createDataFrame(rows[::-1], SCHEMA)).collect()))
    assert again == sorted(map(tuple, got))


def test_base_measures_equal_a_plain_version(spark):
    texts = AWKWARD + [prose(1, 100), prose(2, 30) + " " + prose(2, 30), "one two\none two\n\n \none two", "a b c d e f g h " * 5, "#*$ %&| <> x"]
    for r in quality_rules.base_measures(frame(spark, texts).select("doc_id", "text")).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected


def test_rules_reject_what_is_odd_for_its_group(spark):
    rows = [(i, prose(i, 60), "en", "s", 0) for i in range(80)] + [(100, " ".join(w + "***" for w in prose(1, 60).split()), "en", "s", 0)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got.pop(100) and all(got.values())


def test_languages_are_learned_and_texts_without_letters_are_not(spark):
    letters = {"aa": "abcde", "bb": "vwxyz", "cc": "жзийк"}
    rnd = random.Random(4)
    word = lambda s: "".join(rnd.choice(s) for _ in range(rnd.randint(2, 6)))
    rows = [(i, " ".join(word(letters[lang]) for _ in range(20)), lang, "s", 0) for i, lang in enumerate(list(letters) * 40)]
    rows += [(900, None, "aa", "s", 0), (901, "123 !?", "bb", "s", 0), (902, "abc dea", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = lang_id.fit(docs.where(~lang_id.held_out()), per_lang=2)
    got = {r.doc_id: r for r in lang_id.identify(docs, model, reject=False).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:120]) and got[902].lang_pred == "aa"
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901)] == [("und", 0.0)] * 2
    assert all(0 <= r.score <= 1 for r in got.values())
    strange = frame(spark, ["漢字漢字 漢字"])
    assert lang_id.identify(strange, model).first().lang_pred == "und" and lang_id.identify(strange, model).first().rejected
    assert {r.doc_id for r in docs.where(lang_id.held_out()).collect()} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}


def test_grades_are_ordered(spark):
    good, fair, poor = "fine clear sound useful".split(), "fine clear rude nasty".split(), "### *** $$$ %%%".split()
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(kind) for _ in range(30)), "en", "s", 0) for i, kind in enumerate([good, fair, poor] * 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    grades = spark.createDataFrame([(i, 2 - i % 3) for i in range(0, 150)] + [(None, 1), (3, None), (999, 2)], "doc_id long, grade int")
    model = quality_model.fit(docs, grades)
    assert model.thresholds[0] < model.thresholds[1]
    for r in quality_model.graded(docs, model).collect():
        assert r.selected == (r.doc_id % 3 != 2) and r.tails[0] >= r.tails[1]
        assert round(r.expected_grade) == 2 - r.doc_id % 3
    one = quality_model.fit(docs, grades.where("grade = 1"))
    assert one is None and quality_model.graded(docs, one).where("NOT selected").count() == 0


ENTITIES = "Mary Smith met Peter Jones (Анна Петрова). A.Bc9@Mail5.Example.com or a.bc9@mail5.example.com, +1 (743) 555-3824, 743-555-3824, 10.2.3.4, 4111 1111 1111 1111, 4716652987654321, 123-45-6789, key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff. Mary Smith left."


def test_surrogates_keep_form_coreference_and_distinctness(spark):
    made = pii.Surrogates(b"key")
    text, spans = pii.replaced(ENTITIES, made)
    kinds = [s[2] for s in spans]
    assert kinds == ["person", "person", "person", "email", "email", "phone", "phone", "ip", "card", "card", "ssn", "secret", "person"]
    assert [(s, e, k) for s, e, k, _ in spans if k not in ("person", "ip")] and [x[2] for x in pii.found(text)] == kinds
    assert not any(ENTITIES[s:e] in text for s, e, *_ in spans)
    new = [s[3] for s in spans]
    assert new[0] == new[12] and new[3].lower() == new[4].lower() and new[5][-8:] == new[6][-8:]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[5]) and pii.GENDER[new[0].split()[0]] == ("latin", "f") and pii.GENDER[new[2].split()[0]] == ("cyrillic", "f")
    luhn = lambda t: pii.check_digit([int(c) for c in t if c.isdigit()][:-1]) == int(t[-1])
    assert luhn(new[8]) and luhn(new[9]) == luhn("4716652987654321")
    assert len({made.of(f"{i:03d}-55-1234", "ssn") for i in range(1000)}) == 1000
    assert len({made.phone(f"2{i:02d}-555-0199") for i in range(100)}) == 100
    assert made.of("10.2.3.4", "ip") != pii.Surrogates(b"other").of("10.2.3.4", "ip")
    df = frame(spark, [ENTITIES, ENTITIES, None, "no data"])
    listed = pii.entities(df, b"key")
    assert pii.collisions(listed).count() == 0 and listed.count() == 10
    rows = pii.surrogate_texts(df, b"key").orderBy("doc_id").collect()
    assert rows[0].text == rows[1].text == text and rows[2].text is None and rows[3].text == "no data" and rows[3].entities == []
    torn = spark.createDataFrame([("ip", "a", "x", 1), ("ip", "b", "x", 1), ("ip", "b", "y", 1)], listed.schema)
    assert sorted(r.what for r in pii.collisions(torn).collect()) == ["shared", "torn"]


def test_names_of_a_family_accents_and_titles():
    made = pii.Surrogates(b"key")
    text, spans = pii.replaced("Mary Smith, Peter Smith and Anna B. Smith; Smith's dog. Mary left. Karl Müller, Eva Dvořák, Jane O'Brien, Ivan Łuk. Dr. Weiß and Mrs Novák.", made)
    assert len(spans) == 11 and {k for *_, k, _ in spans} == {"person"}
    new = [s[3] for s in spans]
    assert len({n.split()[-1] for n in new[:3]} | {new[3]}) == 1 and new[4] == new[0].split()[0]
    assert not any(w in text for w in "Smith Mary Peter Karl Müller Dvořák Brien Łuk Weiß Novák".split())
    for old, n in zip("Müller Dvořák O'Brien Łuk".split(), (x.split()[-1] for x in new[5:9]), strict=True):
        assert len(old) == len(n) and all(o.isupper() == c.isupper() and (pii.class_of(o) == pii.class_of(c)) for o, c in zip(old, n, strict=True))
    assert pii.replaced("Mary had a lamb. The Smith works. Dr of it.", made)[1] == []


def test_gendered_surnames_keep_stem_ending_and_alphabet():
    made = pii.Surrogates(b"key")
    pairs = [("Иванов", "Иванова"), ("Достоевский", "Достоевская"), ("Пушкин", "Пушкина"), ("Novák", "Nováková"), ("Kowalski", "Kowalska")]
    for man, woman in pairs:
        a, b = made.surname(man), made.surname(woman)
        assert a != man and b != woman and pii.parted(a)[1] == pii.parted(man)[1] and pii.parted(b)[1] == pii.parted(woman)[1]
        if pii.parted(man)[1]:
            assert pii.parted(a)[0] == pii.parted(b)[0]
    assert set(made.surname("Бондаренко").lower()) <= set(pii.ALPHABETS[0]) and set(made.surname("Їжакевич").lower()) <= set(pii.ALPHABETS[1])
    names = [a + b + c + e for a in "БВГ" for b in "аоу" for c in "нлр" for e in ("ов", "ова", "ин", "енко", "ій", "ий")]
    assert len({made.surname(n) for n in names}) == len(names)


@pytest.mark.parametrize("seed", [b"a", b"b"])
def test_addresses_stay_in_their_blocks(seed):
    import ipaddress

    made = pii.Surrogates(seed)
    block = lambda t: next((str(b) for b in pii.BLOCKS if ipaddress.ip_address(t) in b), "public")
    for old in "192.168.0.1 10.1.2.3 172.16.9.9 127.0.0.1 8.8.8.8 224.0.0.1 169.254.1.1 fe80::1 2001:db8::7 fd00:1:2:3:4:5:6:7 ff02::1".split():
        new = made.of(old, "ipv6" if ":" in old else "ip")
        assert new != old and block(new) == block(old)
    assert len({made.ip(f"192.168.{i}.{j}") for i in range(20) for j in range(20)}) == 400
    mac = made.mac("02:1A:2b:3c:4d:5e")
    assert re.fullmatch(r"(?:[0-9a-f]{2}:){5}[0-9a-f]{2}", mac) and int(mac[:2], 16) & 3 == 2
    assert pii.canonical(made.mac("02-1A-2B-3C-4D-5E"), "mac") == pii.canonical(mac, "mac")


def test_new_kinds_are_found_and_keep_their_form():
    made = pii.Surrogates(b"key")
    text = "pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE88 3704 0044 0532 0130 00; at 2001:db8::ff00:42:8329, 00:1B:44:11:3A:B7 at 12:30:45. JOHN SMITH and ПЁТР ИВАНОВ called; Aisha Khan met Wei Zhang, Priya Sharma and Yuki Tanaka."
    spans = pii.found(text)
    assert [k for *_, k in spans] == ["iban", "iban", "card", "ipv6", "mac", "person", "person", "person", "person", "person", "person"]
    new, done = pii.replaced(text, made)
    accounts = [n for _, _, k, n in done if k == "iban"]
    assert [a[:2] for a in accounts] == ["DE", "GB"] and all(pii.account_remainder(a) == 1 for a in accounts) and len(accounts[0]) == 27
    assert done[5][3].isupper() and done[5][3] != "JOHN SMITH" and "12:30:45" in new and "not DE88 " in new


def test_long_entities_are_found_whole():
    made = pii.Surrogates(b"key")
    for entity in ("a1" * 65, "F0" * 40, "0aB9" * 20, "sk-proj-" + "Ab_9-" * 30 + "z", "x" * 300 + "@mail.example.com"):
        text, spans = pii.replaced(f"see {entity}, then", made)
        assert [s[:2] for s in spans] == [(4, 4 + len(entity))] and entity not in text and len(text) == len(entity) + 10


@pytest.mark.parametrize("size", [2, 3, 7, 32, 1000])
def test_nothing_is_its_own_surrogate(size):
    made = pii.Surrogates(b"key")
    got = [made.permuted(x, size, b"t") for x in range(size)]
    assert sorted(got) == list(range(size)) and all(x != y for x, y in enumerate(got))
    names = [f"Jane {a}{b}" for a in "BCDFGH" for b in "aeiou"]
    assert all(made.person(n) != n for n in names) and len({made.person(n) for n in names}) == len(names)


def test_real_surrogates_are_counted_and_avoided(spark, monkeypatch):
    rows = [("ip", "a", "b", 1), ("ip", "b", "c", 1), ("card", "b", "x", 1), ("ip", "d", "d", 1)]
    listed = spark.createDataFrame(rows, "type string, entity string, surrogate string, n bigint")
    assert sorted(r.value for r in pii.real(listed).collect()) == ["b", "d"]
    names = [f"Jane {a}{b}" for a in "BCDFGH" for b in "aeiou"][:4]
    mentioned = pii.mentions(frame(spark, names))
    attempt = pii.settled_attempt(mentioned, b"key", 4)
    counts = [pii.real(pii.surrogates(mentioned, b"key", a)).count() for a in range(4)]
    assert counts[attempt] == min(counts)


def pii_plain(text):
    """Entities by one plain rule each, over the whole text; for texts of words, entities and separators alone."""
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    rules = [
        r"(?<![\w.+%-])\w[\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
        rf"(?<![\w.]){octet}(?:\.{octet}){{3}}(?![\w.])",
        r"(?<!\w)(?:\d{4} ){3}\d{4}(?!\w)",
        r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
        r"(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
        r"(?<!\w)(?=\w*[a-f])(?=\w*\d)[0-9a-f]{32,}(?!\w)",
        rf"(?<!\w)(?:{'|'.join(pii.GENDER)}) [A-Z][a-z]+(?!\w)",
    ]
    return sorted((m.start(), m.end()) for rule in rules for m in re.finditer(rule, text))


def test_entities_equal_a_plain_version():
    rnd = random.Random(12)
    kinds = [
        lambda: f"u{rnd.randrange(99)}.x@mail{rnd.randrange(9)}.example.org",
        lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
        lambda: " ".join(f"{rnd.randrange(10**4):04d}" for _ in range(4)),
        lambda: f"{rnd.randrange(1000):03d}-{rnd.randrange(100):02d}-{rnd.randrange(10**4):04d}",
        lambda: f"{rnd.randrange(200, 1000)}-{rnd.randrange(1000):03d}-{rnd.randrange(10**4):04d}",
        lambda: "a1" + "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(30, 200))),
        lambda: f"{rnd.choice([n for n, g in pii.GENDER.items() if g[0] == 'latin'])} {rnd.choice('BCD')}{''.join(rnd.choice('abcde') for _ in range(5))}",
        lambda: f"w{rnd.randrange(50)}",
    ]
    for _ in range(300):
        text = ", ".join(rnd.choice(kinds)() for _ in range(rnd.randint(1, 30)))
        assert [s[:2] for s in pii.found(text)] == pii_plain(text)


def plain_language(text, model, places=lang_id.PLACES):
    """The cosine of a text with each centroid, by dictionaries of n-grams."""
    import math
    import unicodedata

    folded = "".join(c.lower() if unicodedata.category(c).startswith("L") else " " for c in f" {text} ")
    codes = [ord(c) if c != " " else 0 for c in re.sub(" +", " ", folded)]
    full, shift = (1 << 32) - 1, 32 - places.bit_length() + 1
    tally = collections.Counter()
    for size, salt in ((1, 0x27D4EB2F), (2, 0x165667B1), (3, 0xC2B2AE3D)):
        for i in range(len(codes) - size + 1):
            g = codes[i]
            for c, k in zip(codes[i + 1 : i + size], (0x9E3779B1, 0x85EBCA6B)):
                g = (g * k + c) & full
            tally[((g ^ (g >> 15)) * salt & full) >> shift] += 1
    v = {p: math.log1p(n) * float(model.idf[p]) for p, n in tally.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return [sum(x * float(c[p]) for p, x in v.items()) / norm for c in model.centroids]


def test_languages_equal_a_plain_version(spark):
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "жзийк"}
    rnd = random.Random(14)
    texts = [" ".join("".join(rnd.choice(s) for _ in range(rnd.randint(2, 6))) for _ in range(15)) for s in list(letters.values()) * 30]
    docs = spark.createDataFrame([(i, t, list(letters)[i % 3], "s", 0) for i, t in enumerate(texts)], SCHEMA)
    model = lang_id.fit(docs, per_lang=3)
    asked = [*texts[:20], "Abc-DE  12 fé", "ж", "abcd жзий"]
    for r in lang_id.identify(frame(spark, asked), model, reject=False).collect():
        cosine = plain_language(asked[r.doc_id], model)
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert r.score == pytest.approx(max(cosine), abs=1e-4) and r.lang_pred == model.langs[model.owner[best]]


def test_counts_of_many_short_texts_are_bounded():
    import pyarrow as pa

    from gridloom.llm.base import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["ab"] * 3000 + [None] * 10)], names=["text"])
    parts = [len(t) for _, t in slices(batch, "text", 1 << 20, 512)]
    assert sum(parts) == 3010 and max(parts) == 512


def test_media_query_digests(spark, tmp_path):
    frame(spark, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op6_media(spark, str(tmp_path)).collect():
        raw = (AWKWARD[r.doc_id] or "").encode()
        data = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))


def test_kept_documents_are_good_and_not_toxic(spark, tmp_path):
    kinds = ["fine clear sound useful".split(), "fine clear rude nasty".split(), "### *** $$$ %%%".split()]
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(kinds[i % 3]) for _ in range(30)) for i in range(180)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 < 2), int(i % 3 == 1)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.kept for r in queries.op3_quality_model(spark, str(tmp_path)).collect()}
    assert got == {i: i % 3 == 0 for i in range(180)}


def test_gradient_equals_differences_of_the_likelihood():
    np = quality_model.np
    rnd = np.random.default_rng(1)
    places, n, top = 12, 40, 3
    row = np.repeat(np.arange(n), 4)
    at, value, grade = rnd.integers(0, places, len(row)), rnd.random(len(row)), rnd.integers(0, top + 1, n)
    params = np.concatenate([rnd.normal(size=places), [-0.5], rnd.normal(size=top - 1)])

    def likelihood(p):
        latent = np.bincount(row, p[at] * value, n)
        upto = lambda t: 1 / (1 + np.exp(-(t - latent)))
        edge = [np.zeros(n), *map(upto, quality_model.thresholds(p, places)), np.ones(n)]
        return np.log(np.choose(grade + 1, edge) - np.choose(grade, edge)).mean()

    step = np.eye(len(params)) * 1e-6
    expected = [(likelihood(params + s) - likelihood(params - s)) / 2e-6 for s in step]
    assert quality_model.gradient(params, at, value, row, grade, places, top) == pytest.approx(expected, abs=1e-6)


def test_grades_equal_a_plain_version(spark):
    kinds = ["fine clear sound useful".split(), "fine clear rude nasty".split(), "### *** $$$ %%%".split()]
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(kinds[i % 3]) for _ in range(rnd.randint(1, 40))) for i in range(150)] + [None, "", " "]
    docs = frame(spark, texts)
    model = quality_model.fit(docs, docs.select("doc_id", (2 - F.col("doc_id") % 3).cast("int").alias("grade")))
    place = lambda t: zlib.crc32(t.encode()) % quality_model.PLACES
    classes = lambda w: "".join("a" if c.islower() else "A" if c.isupper() else "l" if c.isalpha() else "0" if c.isdigit() else c for c in w)
    for r in quality_model.graded(docs, model).collect():
        words_, latent = (texts[r.doc_id] or "").split(), 0.0
        tally = collections.Counter(words_)
        norm = sum(quality_model.np.log1p(n) ** 2 for n in tally.values()) ** 0.5
        for w, n in tally.items():
            damped = quality_model.np.log1p(n) / norm
            latent += damped * model.weights[place("w:" + w.strip(".,;:!?"))] + damped * model.weights[place("b:" + w[:4])]
            latent += n / len(words_) * model.weights[place("s:" + "".join(k for k, _ in itertools.groupby(classes(w))))]
        if words_:
            latent += sum(a == b for a, b in itertools.pairwise(words_)) / len(words_) * model.weights[place("repeat")] + 0.2 * model.weights[place("bias")]
        assert r.tails == pytest.approx([1 / (1 + quality_model.np.exp(t - latent)) for t in model.thresholds], abs=1e-4)


def test_shapes_are_of_whole_words():
    shape = quality_model.Features.shape
    assert shape("Ered***") == "Aa*" and shape("x" * 70) == "a" and shape("漢字" * 40 + "É9#!" * 2) == "lA0#!A0#!"
