"""The corpus operators on awkward rows, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalens.llm import op1_simhash, op2_packing, op3_decontamination, op4_html, op5_toxicity, op6_substring, op7_licenses, op8_suffixes, op9_token_files, op10_fingerprints
from stratalens.llm.range_coder import decode_block, encode_block
from stratalens.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, body int, kind string, fp double, hash string, text_hash string, words int, score string, n string, bucket string, blob string"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["Été", "naïve", "X1", "the"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(70), make(200)
    near = base.split(" ")
    near[100] = "changed"
    out = {i: make(rng.randint(1, 90)) for i in range(20)}
    out |= {20: None, 21: "", 22: " \t\n ", 23: base, 24: base, 25: " ".join(near), 26: f"{make(30)} {passage}", 27: f"{passage}\n{make(5)} {passage}", 28: make(30_000), 29: "aaaa " * 500}
    out |= {30: f"{make(12)} {ITEM.upper()} {make(9)}", 31: "CC BY cc by general public license, All rights reserved.", 32: "Released under the MIT License", 33: "é" * 900, 34: "one", 35: "one"}
    return out


@pytest.fixture(scope="module")
def rows():
    body = [(i, t) for i, t in texts().items()] + [(None, "lost id w1 w2 w3"), (None, None), (3, texts()[3]), (3, "another text under an id w1 w2")]
    return body


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, None if i == 5 else "en", "s", None, "k", 1, "x", 0.5, "h", "t", 2, "s", "n", "b", "c") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(pairs):
    return collections.Counter(pairs)


def ordered(rows):
    """Distinct documents, null ids last; those of one id in the order of Spark's hash are made unique by their text."""
    return sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))


def test_op1(docs, rows, empty):
    def fp(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = counted((rows[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(rows)))
    got = op1_simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
    assert counted(map(tuple, got.collect())) == want
    assert op1_simhash.near_duplicates(empty).count() == 0


def test_op1_forest():
    rng = np.random.default_rng(1)
    near = rng.random((40, 50)) < 0.2
    i, j = op1_simhash.forest(near)
    assert near[i, j].all() and len(i) <= 89
    full, cut = op1_simhash.forest(np.ones((30, 20), bool)), None
    assert len(full[0]) == 49 and cut is None


def test_near_duplicate_stage(spark, docs, rows, empty):
    sets = [frozenset(op1_simhash.shingles((t or "").encode(), 5)) for _, t in rows]
    kept = op1_simhash.stage(spark, docs, "").select("doc_id", "text").collect()
    left = [frozenset(op1_simhash.shingles((r.text or "").encode(), 5)) for r in kept]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert not any(alike(a, b) for k, a in enumerate(left) for b in left[:k])
    assert all(any(alike(s, k) for k in left) for s in sets)
    assert op1_simhash.stage(spark, empty, "").count() == 0


def grouped(spark, texts):
    found = op1_simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return sorted(r.doc_id for r in found.where("kept").collect())


def kept_by_all_pairs(texts):
    sets = [frozenset(op1_simhash.shingles(t.encode(), 5)) for t in texts]
    group = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return sorted(set(group))


def edited(rng, words, many):
    out = list(words)
    for at in rng.sample(range(len(words)), many):
        out[at] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_duplicates_around_a_centre_that_is_not_first(spark):
    rng = random.Random(11)
    base = [f"b{rng.randrange(10**9)}" for _ in range(300)]
    texts = [edited(rng, base, 5) for _ in range(200)]
    texts.insert(120, " ".join(base))
    assert grouped(spark, texts) == kept_by_all_pairs(texts) == [0]


def test_near_duplicates_beyond_the_radius(spark):
    rng = random.Random(12)
    apart = lambda a, b: (op1_simhash.simhash(op1_simhash.shingle_hashes(a.encode(), 5)) ^ op1_simhash.simhash(op1_simhash.shingle_hashes(b.encode(), 5))) & (1 << 64) - 1
    texts = []
    while len(texts) < 12:
        base = [f"b{rng.randrange(10**9)}" for _ in range(100)]
        pair = [" ".join(base), edited(rng, base, 2)]
        if apart(*pair).bit_count() > 13:
            texts += pair
    # one set of shingles, counted differently
    list_, prose = [f"l{i}" for i in range(20)], [f"p{i}" for i in range(30)]
    texts += [" ".join(prose + list_ * n) for n in (2, 60)]
    assert grouped(spark, texts) == kept_by_all_pairs(texts) == list(range(0, 14, 2))


@pytest.mark.parametrize("hot", [3, 20])
def test_near_duplicates_at_hot_shingles(spark, hot):
    """Texts are made of shared passages, so the rare shingles of their prefixes are shared by many small groups and a large one."""
    rng = random.Random(13)
    passage = lambda n: [f"s{rng.randrange(10**9)}" for _ in range(n)]
    heads, middles, tails = [passage(40) for _ in range(6)], [passage(12) for _ in range(6)], [passage(6) for _ in range(7)]
    texts = [" ".join(heads[i % 6] + middles[i // 6 % 6] + tails[i % 7] + ([f"e{i}"] if i % 5 == 0 else [])) for i in range(260)]
    texts += [edited(rng, heads[0] + middles[1] + passage(40), 2) for _ in range(30)]
    crowd = heads[1] + passage(60)
    texts += [edited(rng, crowd, 1) for _ in range(60)] + [texts[3]] * 40
    found = op1_simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=hot)
    want = kept_by_all_pairs(texts)
    assert sorted(r.doc_id for r in found.where("kept").collect()) == want and 30 < len(want) < 300


def test_hot_shingles_reach_blocks(spark):
    """Every pair of groups at a hot shingle meets once, in tasks of two blocks; a crowd is one row."""
    rng = random.Random(14)
    rows, texts_at = [], {}
    for root in range(300):
        for node in range(root * 100, root * 100 + (40 if root % 50 == 0 else rng.randrange(1, 4))):
            size = rng.randrange(80, 120)
            texts_at[node] = (root, size, rng.randrange(20, size))
            rows += [(7, node, root, size, texts_at[node][2])] * rng.randrange(1, 3)
    near = lambda m, n: min(m[2], n[2]) >= 0.8 / 1.8 * (m[1] + n[1]) - 1e-6 and min(m[1], n[1]) >= 0.8 * max(m[1], n[1]) - 1e-6
    schema = pa.schema([(n, pa.int64()) for n in ("h", "node", "root", "place", "salt")])
    columns = list(zip(*[(h, node, root, (size << 32) + size - left, root) for h, node, root, size, left in rows]))
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)
    cut = [whole.slice(i, 7) for i in range(0, whole.num_rows, 7)]
    reduced = pa.Table.from_batches(list(op1_simhash.meet(0.8)(iter(cut)))).to_pylist()
    assert sum(r["crowd"] for r in reduced) == 6 and len(reduced) == len({n for n, t in texts_at.items() if t[0] % 50}) + 6
    held = spark.createDataFrame([tuple(r[f.name] for f in list(op1_simhash.MET)[3:]) for r in reduced], "h long, root long, node long, crowd boolean, least long, most long, left long")
    links = {(r.a, r.b, r.wide) for r in op1_simhash.hot_links(held, 25, 0.8).collect()}
    singles = sorted(n for n, t in texts_at.items() if t[0] % 50)
    assert {(a, b) for a, b, w in links if w == 0} == {(m, n) for i, m in enumerate(singles) for n in singles[i + 1 :] if texts_at[m][0] != texts_at[n][0] and near(texts_at[m], texts_at[n])}
    crowds = {root: [t for t in texts_at.values() if t[0] == root] for root in range(0, 300, 50)}
    must = {(n, root, 1) for n in singles for root, own in crowds.items() if any(near(texts_at[n], t) for t in own)}
    assert must <= links  # bounds may let others by


def test_op2(docs, rows, empty):
    ids = encoder(default_path())
    got = op2_packing.pack_documents(docs, default_path(), with_ids=True).collect()
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    for doc_id in {i for i, _ in rows}:
        whole = counted(tuple([*ids._library(t or ""), 0]) for i, t in rows if i == doc_id)
        if sum(whole.values()) == 1:
            joined = [x for r in sorted(pieces[doc_id], key=lambda r: r.start) for x in r.ids]
            assert tuple(joined) in whole
        assert sum(r.length for r in pieces[doc_id]) == sum(len(k) * n for k, n in whole.items())
    for held in places.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
        size = sum(r.length for r in held)
        assert size <= 1024 and size & (size - 1) == 0
    assert op2_packing.pack_documents(empty, default_path()).count() == 0


def test_op2_cuts_few_documents():
    rng = np.random.default_rng(3)
    for many in (rng.integers(1, 3000, 3000), np.full(3000, 600), np.full(3000, 10), np.full(300, 1024), np.array([1]), rng.geometric(0.002, 5000)):
        bins = op2_packing.Bins(1024, 0, False)
        for i, n in enumerate(many.tolist()):
            bins.add(i, np.arange(n, dtype="<u4"))
        bins.finish()
        size, parts = collections.Counter(), {}
        for doc_id, start, length, _, total, sequence, offset in bins.rows:
            assert offset == size[sequence] and length > 0 and total == many[doc_id] and (doc_id, start) not in parts
            size[sequence] += length
            parts[doc_id, start] = length
        assert sum(parts.values()) == many.sum() and all(x <= 1024 and x & (x - 1) == 0 for x in size.values())
        assert len(bins.rows) <= many.size + 2 * len(size) + 12


def test_op3(spark, docs, rows, empty):
    items = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "", 0), (4, "one", 0), (5, texts()[29], 1)], "item_id long, text string, words int")
    got = {(r.doc_id, r.item_id) for r in op3_decontamination.leaks(docs, items).collect()}
    assert got == {(30, 1), (34, 4), (35, 4), (29, 5)}
    assert op3_decontamination.leaks(empty, items).count() == 0 and op3_decontamination.leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [20, 24])
def test_op3_against_all_windows(spark, radius):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 40)))) for i in range(12)]
    docs = []
    for i in range(60):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join([rng.choice(words) for _ in range(rng.randint(0, 20))] + w + [rng.choice(words) for _ in range(rng.randint(0, 9))])))
    want = {}
    for i, t in docs:
        w = t.split()
        for k, x in items:
            y = x.split()
            s = collections.Counter(tuple(y[a : a + 5]) for a in range(len(y) - 4))
            for at in range(max(1, len(w) - len(y) + 1)):
                c = w[at : at + len(y)]
                c = collections.Counter(tuple(c[a : a + 5]) for a in range(len(c) - 4))
                j = sum((c & s).values()) / sum((c | s).values())
                if j >= 0.8:
                    want[i, k] = max(want.get((i, k), 0), round(j, 6))
    found = op3_decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), radius=radius)
    assert {(r.doc_id, r.item_id): r.similarity for r in found.collect()} == pytest.approx(want) and want


def test_op4(spark):
    page = """<html><head><title>T</title><script>if(a<b)"</p>"</script></head><body><header><a href=x>Home</a> Site</header><nav><ul><li><a href=y>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies to do many things that you may like, or not, who knows.</div><main><article><h1>Title &amp; more</h1><p>First <a href=z>link</a>
    line<br>goes&nbsp;on.<p>Short.</p><div class="ad">Buy this now, it is long enough to look like text of a page, is it not?</div><!-- <p>no</p> --><pre>a  b</pre></article>
    <section class="comments"><article><p>A reader says many things about it, at length, and then some more words.</p></article></section></main><footer>&copy; me</footer>"""
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", page, "x"), (4, "u", "<p>" + "long plain text " * 20000, None), (5, "u", "<<<>>&amp <p", "x")], "page_id long, url string, html string, text string")
    got = op4_html.extract_pages(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == "Title & more\n\nFirst link line goes on.\n\nShort.\n\na b" and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == "" and by[4].n_chars == len("long plain text ") * 20000 - 1
    assert op4_html.extract_pages(df.limit(0)).count() == 0


def test_op5(spark, docs, rows, empty):
    toxic = [(i, f"{t or ''} you awful stinker", 1) for i, t in list(texts().items())[:12]]
    clean = [(i, t, 0) for i, t in list(texts().items())[:20]]
    model = op5_toxicity.train(spark.createDataFrame(toxic + clean + [(99, None, None)], "doc_id long, text string, toxic int"), exceptions=("stinker badge",))
    assert model.score("you awful stinker") > 0.5 > model.score("the w1 w2") and model.score("a ＳＴ1ΝΚЕR") == pytest.approx(model.score("a stinker"))
    assert model.score("a stinker badge") == pytest.approx(model.score("a good badge"))
    scored = op5_toxicity.score_documents(docs, model)
    assert scored.count() == len(rows) and scored.where("score between 0 and 1 and predicted = int(score >= 0.5)").count() == len(rows)
    assert op5_toxicity.score_documents(empty, op5_toxicity.train(spark.createDataFrame([], "text string, toxic int"))).count() == 0


def test_op5_masked_words_after_punctuation():
    for masked, plain in (('"1diot"', '"idiot"'), ("(m0ron),", "(moron),"), ("you-1diot", "you-idiot"), ("[$tup1d]", "[stupid]"), ("a 1d1ot!", "a idiot!")):
        assert op5_toxicity.fold(masked) == plain
    assert op5_toxicity.fold("(10) 10-20 $5") == "(10) 10-20 $5"


def test_op5_held_out_accuracy(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    got = op5_toxicity.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.9


def brute_words(rows, window):
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [4, 20])
def test_op6(docs, rows, empty, window):
    distinct = [r for r in ordered(rows) if r[0] != 3]  # two texts of one id go by hash
    got = op6_substring.dedup_substrings(docs.where("doc_id is null or doc_id <> 3"), window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert counted(map(tuple, got.collect())) == counted(brute_words(sorted(distinct, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None)), window))
    assert op6_substring.dedup_substrings(docs, window).count() == len(rows)
    assert op6_substring.dedup_substrings(empty, window).count() == 0


def test_op6_stage(spark, docs, rows):
    out = op6_substring.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(rows)


@pytest.mark.parametrize("length", [40, 400])
def test_op8(docs, rows, empty, length):
    distinct = ordered(rows)
    count = collections.Counter(t.encode()[p : p + length] for _, t in distinct if t for p in range(len(t.encode()) - length + 1))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = op8_suffixes.dedup_suffixes(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert counted(map(tuple, got.collect())) == counted(want)
    assert op8_suffixes.dedup_suffixes(empty, length).count() == 0


def test_op7(docs, rows, empty):
    got = op7_licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (3, None)}
    assert (by[31].n_base, by[31].first_word, by[31].last_word, by[31].base_labels) == (4, 0, 7, "cc-by,gpl,reserved")
    assert (by[32].n_base, by[32].first_word, by[32].labels, by[32].score) == (0, None, "mit", 1.0) and by[20].n_words == by[21].n_words == 0
    for i, t in rows:
        if i in by:
            assert by[i].n_words == len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))
    assert op7_licenses.scan_licenses(empty).count() == 0


def test_op9(spark, docs, rows, empty, tmp_path):
    op9_token_files.write_token_files(docs, str(tmp_path / "a"), default_path())
    got = op9_token_files.read_token_files(spark, str(tmp_path / "a"), with_ids=True).orderBy("start").collect()
    ids = encoder(default_path())
    assert counted((r.doc_id, tuple(r.ids)) for r in got) == counted((i, (*ids._library(t or ""), 2)) for i, t in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and all(r.doc_id is None for r in got[len(known) :])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    op9_token_files.write_token_files(empty, str(tmp_path / "b"), default_path())
    assert op9_token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_range_coder_round_trips():
    rng = np.random.default_rng(5)
    for ids in (np.zeros(0), np.array([5]), np.zeros(5000), rng.integers(0, 50257, 3000), np.minimum(rng.geometric(0.01, 40_000), 50_256), np.arange(20_000)):
        ids = ids.astype(np.uint32)
        assert (decode_block(encode_block(ids, 50257)) == ids).all()
    record = bytearray(encode_block(np.arange(5000, dtype=np.uint32), 50257))
    record[len(record) // 2] ^= 1
    with pytest.raises(ValueError):
        decode_block(bytes(record))


def test_tokens_equal_the_library():
    tool, rng = encoder(default_path()), random.Random(2)
    assert tool.twin is not None
    odd = ["a   b", "x<|endoftext|> y", "  lead", "trail  ", "it's we'll 'll", *("".join(rng.choice(" \n\tab'1.é　<|") for _ in range(50)) for _ in range(500))]
    assert all(tool.ids(x).tolist() == tool._library(x) for x in odd)
    latin = [*("".join(rng.choice("abtsdmlrveLé ñß'''  \n\t\r.,!12½\x85\xa0\x1c“”’€") for _ in range(rng.randint(0, 60))) for _ in range(3000)), "x" * 200 + " " + "y" * 70, "'" * 90, "it's'tis 've're", "don't 'll 's", ""]
    signs = [f"a{c}b {c} {c}{c}1'{c}s\n{c}" for c in map(chr, (*range(1, 0x260), *range(0x2010, 0x2060), 0x20AC))]
    for mixed in (latin + odd, signs, latin):  # some pieces new, then all of them met before
        assert all(a.tolist() == tool._library(b) for a, b in zip(tool.many(mixed), mixed))


def test_op10_places_and_whole_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    moved = words[4000:] + words[2000:4000] + words[:2000]
    changed = words[:3000] + [f"x{i}" for i in range(10)] + words[3010:]
    shifted = ["y"] * 5 + words
    df = spark.createDataFrame([(" ".join(words), " ".join(x)) for x in (words, moved, changed, shifted)], "a string, b string")
    same, order, edit, shift = (r[0] for r in df.select(op10_fingerprints.likeness(op10_fingerprints.packed_anchors(F.col("a")), op10_fingerprints.packed_anchors(F.col("b")))).collect())
    assert same == 1 and order < 0.4 and 0.99 < edit < 1 and shift > 0.99


def test_op10(docs, rows, empty):
    got = op10_fingerprints.fingerprint_documents(docs.where("doc_id is null or doc_id <> 3")).collect()
    own = [r for r in rows if r[0] != 3]
    assert len(got) == len(own)
    down = sorted({i: t for i, t in own if i is not None}.items(), reverse=True)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for (i, t), (_, after) in zip(down[:-1], down[1:]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (by[i].n_chars, by[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert by[23].fingerprint == by[24].fingerprint and by[24].near_next == 1.0 and by[23].near_edited < 1
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert op10_fingerprints.fingerprint_documents(empty).count() == 0


def chained(*values):
    """Spark's xxhash64 of texts and longs, as a signed number."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def anchors(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    if len(w) < 4:
        return [(chained(*w) & 0xFFFFFFFF, 0)] if w else []
    h = [chained(a, b) for a, b in zip(w, w[1:])]
    return sorted((chained(h[i], h[i + 2]) & 0xFFFFFFFF, i) for i in range(len(w) - 3) if min(h[i], h[i + 2]) <= h[i + 1])


def alike(a, b):
    if not a and not b:
        return 1.0
    of = lambda xs: {h: [p for x, p in xs if x == h] for h, _ in xs}
    first, second = of(a), of(b)
    found = [q - p for h in first for p, q in zip(first[h], second.get(h, []))]
    width = max(16, max(len(a), len(b)) // 16)
    best = max((n for move in (0, width // 2) for n in collections.Counter((d + move) // width for d in found).values()), default=0)
    return round(best / (len(a) + len(b) - best), 6)


def test_op10_against_brute_force(docs, rows):
    order = sorted({(i if i is not None else -(1 << 63), chained(t or ""), t or "") for i, t in rows}, reverse=True)
    following = {x[:2]: order[(k + 1) % len(order)][2] for k, x in enumerate(order)}
    want = []
    for i, t in rows:
        t = t or ""
        after = following[(i if i is not None else -(1 << 63), chained(t))]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b = anchors(t), anchors(edited)
        text = lambda xs: "".join(f"{(h << 24) + p:014x}" for h, p in xs)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), alike(a, b), alike(a, anchors(after))))
    got = op10_fingerprints.fingerprint_documents(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert counted(map(tuple, got)) == counted(want)


def test_op10_ranges(spark):
    """Many more ranges than a group holds: every document is followed by the next id below."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string"), F.lit(" and more words")).alias("text"))
    held = op10_fingerprints.GROUP
    op10_fingerprints.GROUP = 3
    try:
        got = {r.doc_id: r.edited_sha256 for r in op10_fingerprints.fingerprint_documents(docs).select("doc_id", "edited_sha256").collect()}
    finally:
        op10_fingerprints.GROUP = held
    text = lambda i: f"text of {i} and more words"
    for i in range(3000):
        own, after = text(i), text(i - 1 if i else 2999)
        half = len(own) // 2
        assert got[i] == hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest(), i


def smallest_of_groups(rows):
    """The smallest id of each group of texts that are linked by a similarity of 0.8 or more, by all pairs that share a shingle."""
    sets = {}
    for i, text in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sorted(sets):
        shared = collections.Counter(j for x in sets[i] for j in where[x] if j < i)
        for j, n in shared.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    empty = [i for i in sets if not sets[i]]
    for i in empty:
        group[top(i)] = top(min(empty))
    return {i for i in sets if top(i) == i}


def test_near_duplicates_leave_no_similar_pair(spark):
    """Of the documents of a whole table that are kept, no two reach the similarity; one of each group is kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in op1_simhash.stage(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    assert kept == smallest_of_groups((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_near_duplicates_of_large_groups(spark):
    """Two crowds of copies, texts at the edge of the similarity to some of their members, and texts that share a passage with all."""
    rng = random.Random(12)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]

    def edited(base, n):
        out = list(base)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"e{rng.randrange(10**6)}"
        return " ".join(out)

    first, passage = words(150), words(60)
    second = first[:100] + words(50)
    texts = [edited(first, 1) for _ in range(70)] + [edited(second, 1) for _ in range(40)] + [edited(first, k) for k in (2, 3, 4, 5, 6) for _ in range(8)] + [edited(second, k) for k in (3, 4, 5) for _ in range(6)]
    texts += [" ".join(passage + words(20)) for _ in range(30)] + [" ".join(words(80) + passage) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in op1_simhash.stage(spark, docs, "").select("doc_id").collect()} == smallest_of_groups(rows)


def test_op5_features_against_brute_force():
    """Overlapping entries, beginnings of words, exception phrases and masked words."""
    rng = random.Random(21)
    words = ["scum", "scums", "trash", "can", "pond", "clown", "fish", "idiot", "idiotic", "idio", "sc", "umbrella", "the", "1d10t", "Tr@sh", "сlоwn", "fîsh"]
    weights = {" scum ": 2.0, " scum": 1.5, " idiot": 3.0, " idio": 1.0, " idiot ": 2.5, " trash ": 1.25, " clown ": 0.75, " um": 9.0}
    model = op5_toxicity.Model(weights)

    def brute(text):
        own = re.findall(r"[^\W_]+", op5_toxicity.fold(text))
        line = " " + " ".join(own) + " "
        found = lambda x: [i for i in range(len(line)) if line.startswith(x, i)]
        spared = [(i, i + len(x) + 1) for x in op5_toxicity.EXCEPTIONS for i in found(f" {x} ")]
        best = {}
        for entry, weight in weights.items():
            for i in found(entry):
                best[i] = max(best.get(i, 0.0), weight)
        total = sum(w for i, w in best.items() if not any(a <= i < b for a, b in spared))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(len(own), 10)))

    for _ in range(2000):
        text = "".join(rng.choice(words) + rng.choice((" ", " ", ", ", "!", "\n", "-")) for _ in range(rng.randint(0, 12)))
        assert model.features(text) == pytest.approx(brute(text)), text


def test_op5_repeated_labels_and_rows(spark, tmp_path):
    rows = [(i, f"you utter scum number {i}" if i % 3 == 0 else f"a fine day number {i}", "en", "s", 1) for i in range(300)]
    rows += [(0, "you utter scum number 0", "en", "s", 1), (7, "another text under seven", "en", "s", 1), (None, None, None, None, None)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 1, 1), (0, 1, 0), (5, 1, None), (None, 1, 1), (9999, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    got = op5_toxicity.op5_toxicity(spark, str(tmp_path)).collect()
    assert counted(r.doc_id for r in got) == counted(r[0] for r in rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None) >= 295
