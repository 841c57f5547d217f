"""Each operator against a plain version, on the small input and on rows with nulls, empty and long texts, ties,
repeated rows and clashing column names."""

import hashlib
import heapq
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridloom.llm import covertree, html_text, idfile, linededup, packing, sharding, simhash, suffix, tokens
from gridloom.llm.decontaminate import contaminated
from gridloom.llm.linededup import dedup_lines
from gridloom.llm.quality import fit, keep_quality, score_quality
from gridloom.llm.suffix import repeated_passages
from gridloom.llm.tokens import public_path, text_ids

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row long, fp long, n long, piece int, set long, lang string"


def _rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["été", "Straße", "don't", "3.14", "日本語", " x", "<|endoftext|>"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  \n", ". "]) for _ in range(n))
    base = [text(rng.randrange(1, 90)) for _ in range(40)]
    base += [base[3], base[3] + " one more", base[4].replace("w1", "w2"), base[5].upper(), "", " \n\t", "one", "a\nb\na", "\n", None]
    base += [text(60_000), "x" * 200_000, base[6][10:] + base[7][:200]]
    rng.shuffle(base)
    return [(10 * i + 1, t) for i, t in enumerate(base)] + [(2**60 + 7, base[0])]


@pytest.fixture(scope="module")
def small(spark):
    """(DataFrame, rows) with distinct ids, other columns of any name, and nulls in them."""
    rows = _rows()
    df = spark.createDataFrame([(i, t, None, 1, None, 2, 3, None) for i, t in rows], SCHEMA)
    return df.repartition(3).cache(), rows


@pytest.fixture(scope="module")
def given(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(params=["small", "given"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids beside large ones, and repeated rows."""
    rows = [(None, "a b c d e f g"), (None, None), (2**60 + 7, "a b c d e f g"), (2**60 + 7, "a b c d e f g"), (5, ""), (5, None), (6, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- packing -------------------------------------------------------------------------------------------------------


def _packed(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs):
    df, rows = docs
    found = packing.pack_documents(df, public_path("byte_bpe_50k.json")).collect()
    expected = brute.pieces([i for i, _ in rows], brute.token_ids([t for _, t in rows], "byte_bpe_50k.json", 0))
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(expected)
    starts = {}
    for r in found:
        starts.setdefault(r["doc_id"], []).append((r["piece"], r["start"]))
    assert all([p for p, _ in sorted(own)] == list(range(len(own))) and sorted(own) == sorted(own, key=lambda x: x[1]) for own in starts.values())
    assert _packed(found) <= brute.best_fit_decreasing([e[2] for e in expected])


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_are_those_of_the_library(name, kind):
    """Strings of added tokens, in and around words, other scripts, odd spaces: as encode() gives them by default."""
    rng = random.Random(11)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "  ", "\n", "Word", "été", "'s", "12", "日本", "ǅ", "\u2028", "!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(3000)]
    encode = text_ids(public_path(name), kind)
    for text, own in zip(texts, brute.token_ids(texts, name, 0), strict=True):
        assert encode(text) + bytes(4) == own.tobytes()


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_of_split_texts(name, kind):
    """Full stops, commas and white space in all places: the ids are those of the whole text."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("aZé19 .,'\"-  \n\n\t\rst's..,!") for _ in range(rng.randrange(14))) for _ in range(4000)]
    encode = text_ids(public_path(name), kind)
    for text, own in zip(texts, brute.token_ids(texts, name, 0), strict=True):
        assert encode(text) + bytes(4) == own.tobytes()


def test_frequent_words_stay_known(monkeypatch):
    """Words that come again and again go through the model once, however many others pass; the cache stays bounded."""
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    encode, made = tokens.TextIds(public_path("word_bpe_49k.json"), "word"), Counter()
    make = encode.words.make
    encode.words.make = lambda word: made.update([word]) or make(word)
    for k in range(200):
        encode(f"the house {'abcdefghij'[k % 10] * (k // 10 + 3)}, the garden.")
    assert {made[w] for w in ("the", "house", "garden", ",", ".")} == {1}
    assert len(encode.words) + len(encode.words.before) <= 20


def test_packing_odd_rows(odd, nothing):
    found = packing.pack_documents(odd[0], public_path("byte_bpe_50k.json")).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in odd[1])
    assert _packed(found) == 1
    assert packing.pack_documents(nothing, public_path("byte_bpe_50k.json")).count() == 0


def test_places_of_displaced_items():
    """The search by room finds the places that looking at all items finds, ties included."""
    rng = np.random.default_rng(7)
    for capacity, top in ((2048, 900), (2048, 2048), (30, 20)):
        lengths = rng.integers(1, top + 1, 1000)
        child = packing.best_fit(lengths, capacity, lengths * rng.uniform(0.5, 1.5, 1000))
        kept = rng.random(child.max() + 1)[child] < 0.7
        items = np.flatnonzero(~kept)
        items = items[np.argsort(-lengths[items])]
        plain = [child.copy(), kept.copy()]
        out = brute.places_taken(plain[0], items, plain[1], lengths, capacity)
        assert packing._replace(child, items, kept, lengths, capacity).tolist() == out
        assert (child == plain[0]).all() and (kept == plain[1]).all() and out != items.tolist()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_evolution_improves_on_best_fit(seed):
    rng = np.random.default_rng(seed)
    # triples that fill bins exactly, which best fit misses
    a, b = rng.integers(300, 900, 300), rng.integers(300, 500, 300)
    lengths = np.r_[a, b, 2048 - a - b]
    rng.shuffle(lengths)
    start = packing.best_fit(lengths, 2048, lengths.astype(float))
    best = packing.evolve(lengths, 2048, [], [seed], 60)[0]
    bins = lambda p: -packing.fitness(p, lengths, 2048)[0]
    assert bins(start) == brute.best_fit_decreasing(lengths.tolist())
    assert bins(best) < bins(start)
    assert len(best) == 900 and np.bincount(best, lengths).max() <= 2048
    child = packing.crossover(start, packing.best_fit(lengths, 2048, rng.random(900)), lengths, 2048, rng)
    assert len(child) == 900 and np.bincount(child, lengths).max() <= 2048
    # a packing that is given is never lost
    assert bins(packing.evolve(lengths, 2048, [best], [seed], 0)[0]) <= bins(best)


def test_packing_of_many_problems_loses_little_to_one(spark, monkeypatch):
    """Problems that are packed apart, then their loose bins together: close to what the total length needs."""
    monkeypatch.setattr(packing, "PROBLEM_PIECES", 128)
    rng = np.random.default_rng(5)
    rows = [(i, int(n)) for i, n in enumerate(np.minimum(2048, rng.lognormal(5.5, 1.2, 1500)).astype(int) + 1) if n <= 2048]
    found = packing.pack_pieces(spark.createDataFrame(rows, "doc_id long, length long").repartition(3), 2048).collect()
    assert sorted((r["doc_id"], r["length"]) for r in found) == sorted(rows)
    used, least = _packed(found), -(-sum(n for _, n in rows) // 2048)
    assert used <= least + 2
    apart = sum(-(-sum(n for _, n in rows[k::12]) // 2048) for k in range(12))
    assert used < apart


# --- quality -------------------------------------------------------------------------------------------------------


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum())


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).toPandas()
    assert found["doc_id"].is_unique and found["score"].between(0, 1).all()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]).all()
    assert (found["predicted"] == (found["score"] >= 0.3)).all()
    held = found[found["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert _auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.85


def test_quality_uses_no_held_out_label_and_no_other_column(spark, given):
    df, _ = given
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    shape = lambda d: sorted((r["doc_id"], r["score"]) for r in d.collect())
    plain = shape(score_quality(df, labels))
    assert plain == shape(score_quality(df.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")}), flipped))
    kept = keep_quality(df, labels)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, s in plain if s >= 0.3]


def test_quality_odd_rows(spark, odd, nothing, small):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = score_quality(odd[0], none).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in odd[1])
    assert {r["score"] for r in found} == {0.5}
    assert score_quality(nothing, none).count() == 0
    labels = spark.createDataFrame([(1, None), (11, 1), (11, 0), (21, 7), (None, 1), (31, 0)], "doc_id long, quality int")
    assert score_quality(small[0], labels).count() == len(small[1])


def test_conflicting_labels_give_the_same_scores(spark, given):
    """Labels and rows of one id in any order."""
    df, rows = given
    labels = [(i, k) for i, _ in rows[:80] for k in ((i % 2, 1 - i % 2) if i % 3 else (i % 2,))]
    shape = lambda lab, d: sorted((r["doc_id"], r["score"]) for r in score_quality(d, spark.createDataFrame(lab, "doc_id long, quality int").repartition(3)).collect())
    twice = df.unionByName(df.withColumn("text", F.concat("text", F.lit(" more"))))
    assert shape(labels, twice) == shape(labels[::-1], twice.repartition(5))


def test_trees_separate():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert _auc(fit(x[:1500], y[:1500]).score(x[1500:]), y[1500:]) > 0.97


# --- id files ------------------------------------------------------------------------------------------------------


def test_id_file(spark, docs, tmp_path):
    df, rows = docs
    rows = sorted(rows)
    expected, start = [], 0
    ids = brute.token_ids([t for _, t in rows], "word_bpe_49k.json", 2)
    for (i, _), own in zip(rows, ids, strict=True):
        expected.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    found = idfile.id_file_round_trip(df, public_path("word_bpe_49k.json"))
    assert sorted(map(tuple, found.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected
    idfile.write_id_file(idfile.encode_documents(df, public_path("word_bpe_49k.json")), str(tmp_path / "f"))
    back = {r["doc_id"]: r["ids"] for r in idfile.read_id_file(spark, str(tmp_path / "f"), with_ids=True).collect()}
    assert all(bytes(back[i]) == own.tobytes() for (i, _), own in zip(rows, ids, strict=True))


def test_id_file_odd_rows(odd, nothing):
    found = idfile.id_file_round_trip(odd[0], public_path("word_bpe_49k.json")).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in odd[1])
    at = sorted((r["start"], r["n_tokens"]) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))
    assert idfile.id_file_round_trip(nothing, public_path("word_bpe_49k.json")).count() == 0


def _huffman_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        n = heapq.heappop(heap) + heapq.heappop(heap)
        cost += n
        heapq.heappush(heap, n)
    return cost


def test_code_lengths():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = rng.integers(0, 50, rng.integers(2, 200))
        lengths = idfile.code_lengths(counts)
        if (counts > 0).sum() > 1:
            assert int((lengths * counts).sum()) == _huffman_cost(counts.tolist())
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = idfile.code_lengths(np.array(fib)).astype(int)
    assert lengths.max() <= idfile.MAX_BITS and sum(2.0**-n for n in lengths) <= 1


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 60_000).astype(np.uint16)
    lengths = idfile.code_lengths(np.bincount(ids, minlength=1 << 16))
    payload, marks = idfile.encode_block(ids, idfile.canonical_codes(lengths), lengths)
    assert (idfile.decode_block(payload, n, marks, idfile.decoding_table(lengths)) == ids).all()


# --- html ----------------------------------------------------------------------------------------------------------

PAGE = """<title>no</title><style>p{}</style><h1>Head &amp; more</h1><p>One<p>Two  words<br>next<!-- no --><div hidden>no</div>
<div style="display: none">no</div><ul><li>a<li>b</ul><ol><li>x<li>y</ol><table><tr><th>Name<th>n<tr><td>Anna<td>1</table><pre>k
  l</pre><script>no</script><p>end <b>bold</b>text"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 1), (3, "u", "", 2), (None, "u", "<p>x", 3)], "page_id long, url string, html string, text long")
    found = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    lines = found[1].split("\n")
    assert "Head & more" in lines and "Two words" in lines and "next" in lines and "end boldtext" in lines
    assert not any(x.split() == ["no"] for x in lines)
    assert [x for x in lines if x.endswith(" a") or x.endswith(" b")] and "1. x" in [x.strip() for x in lines]
    head, row = (next(x for x in lines if k in x) for k in ("Name", "Anna"))
    assert head.index("n", 4) == row.index("1")
    assert lines[lines.index("k") + 1] == "  l" and "" in lines
    assert len(found) == 4 and not found[2] and not found[3] and found[None] == "x"


def test_html_keeps_every_visible_word(spark):
    """The words of each page, as an event parser sees them; marks of list items come on top."""
    rows = brute.table("/root/testdata/sf0.01/pages.parquet")
    found = html_text.extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert len(found) == len(rows)
    texts = {r["page_id"]: r["text"] for r in found}
    for r in rows:
        own, seen = Counter(texts[r["page_id"]].split()), brute.visible_words(r["html"])
        assert not seen - own
        assert all(re.fullmatch(r"-|\d+\.", w) for w in own - seen)
    assert html_text.extract_text(spark.read.parquet(f"{SF}/pages.parquet").limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<p" * 200_000, '<a ">' * 60_000, "<a '" * 100_000 + ">x", "<" * 100_000, "</" * 200_000, "<!-" * 100_000, "<ul><li>" * 20_000 + "z", "<div>" * 20_000 + "</x>" * 20_000 + "z", "<b>x</b> " * 50_000, '<table><tr>' + '<td colspan=1000 rowspan=1000>x' * 3_000])
def test_html_takes_time_in_proportion(page):
    began = time.perf_counter()
    html_text.page_text(page)
    assert time.perf_counter() - began < 20


def test_html_odd_tags():
    assert html_text.page_text('<p title="a>b">x</p>') == "x"
    assert html_text.page_text('<p title="a>b<b>y</b>') == "by"  # a quote that is never closed
    assert html_text.page_text("a < b <3 c") == "a < b <3 c"
    assert html_text.page_text("x <b class='unfinished") == "x"
    assert html_text.page_text("x <!-- y") == "x"


# --- repeated passages ---------------------------------------------------------------------------------------------


def test_passages(docs):
    df, rows = docs
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_passages(df).collect()}
    assert found == brute.passages_removed(rows)


def test_passages_of_a_narrow_alphabet(spark):
    rng = random.Random(8)
    block = ["".join(rng.choice("ab") for _ in range(120)) for _ in range(4)]
    rows = [(i, "".join(rng.choice([*block, "ab" * 30, "a" * 70, "日本" * 12])[rng.randrange(9) :] for _ in range(4))) for i in range(60)]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert found == brute.passages_removed(rows)


def test_passages_odd_rows(spark, nothing):
    same = "0123456789" * 8
    rows = [(None, same), (2**60 + 7, same), (2**60 + 7, same), (2**60 + 6, same), (3, None), (4, "")]
    found = sorted((str(r["doc_id"]), r["n_removed"]) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted([("None", 0), (str(2**60 + 7), 80), (str(2**60 + 7), 80), (str(2**60 + 6), 0), ("3", 0), ("4", 0)])
    assert repeated_passages(nothing).count() == 0


# --- near duplicates -----------------------------------------------------------------------------------------------


def _simhash_expected(rows, budget=4):
    fps = [brute.simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= budget]
    return sorted((str(i), f"{fp:016x}", c) for (i, _), fp, c in zip(rows, fps, brute.components([i for i, _ in rows], links), strict=True))


def test_near_duplicates(docs):
    df, rows = docs
    found = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert found == _simhash_expected(rows)


def test_near_duplicates_odd_rows(odd, nothing):
    found = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd[0]).collect())
    assert found == _simhash_expected(odd[1])
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("budget", [4, 8])
def test_fingerprint_links_connect_what_is_near(spark, budget, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 64)  # so that groups are cut into blocks
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = []
    for c in centres:
        for _ in range(20):
            flips = rng.choice(64, rng.integers(0, 9), replace=False).astype(np.uint64)
            fps.append(int(c ^ np.bitwise_xor.reduce(np.uint64(1) << flips, initial=np.uint64(0))))
    # a dense ball: more copies of one prefix than a group holds
    fps += [int(centres[0]) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), budget).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert all((fps[at[r["a"]]] ^ fps[at[r["b"]]]).bit_count() <= budget for r in links)
    own = brute.components(list(range(len(fps))), [(at[r["a"]], at[r["b"]]) for r in links])
    every = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= budget]
    assert own == brute.components(list(range(len(fps))), every)


def test_near_duplicates_by_similarity_lose_no_link_of_a_dense_group(spark, monkeypatch):
    """Equal and near fingerprints, of which the first text is like none of the others or only like some."""
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base[:k] + [f"x{j}"] * (k < 40) + base[k:]) for j in range(4) for k in (0, 20, 40)]
    texts += [" ".join(f"{c}{i}" for i in range(30)) for c in "pqr"]
    texts += [f"{texts[-1]} more", "", "one", "two"]
    # like a chain: each like the next, not all like the first
    texts += [" ".join(base[k : k + 34]) for k in range(0, 7, 2)]
    rows = list(enumerate(texts))
    real = simhash.fingerprints

    def dense(*args, **kw):  # all in a few fingerprints near each other
        found = real(*args, **kw).withColumn("fp", F.pmod("fp", F.lit(4)))
        return found.withColumn("prints", F.transform("prints", lambda x: F.pmod(x, F.lit(4))))

    monkeypatch.setattr(simhash, "fingerprints", dense)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, similarity=0.8).collect()}
    expected = brute.components([i for i, _ in rows], brute.jaccard_pairs(texts))
    assert [found[i] for i, _ in rows] == expected


# --- top k ---------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = covertree.top_k(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute.top_k(rows)


def _points(n, size, seed):
    rng = np.random.default_rng(seed)
    return np.floor(rng.normal(size=(n, size)) * 100)


def test_cover_trees_have_levels_and_prune():
    """Each point is a node once, within the radius of all nodes above; clusters far from each other are not looked at."""
    rng = np.random.default_rng(7)
    clustered = np.floor(np.repeat(_points(100, 64, 1) * 3, 40, 0) + rng.normal(size=(4000, 64)) * 3)
    for points in (clustered, _points(3000, 64, 2), np.repeat(_points(5, 8, 3), 200, 0), _points(1, 3, 4), np.zeros((50, 0))):
        tree = covertree.Tree.of(points, np.arange(len(points)) * 3)
        assert sorted(tree.ids.tolist()) == list(range(0, 3 * len(points), 3))
        for i in range(len(points)):
            own = tree.points[i : i + tree.size[i]]
            assert np.sqrt(((own - tree.points[i]) ** 2).sum(1)).max() <= tree.radius[i]
        again = covertree.Tree.from_bytes(*tree.to_bytes(), *points.shape)
        assert (again.points == tree.points).all() and (again.kids == tree.kids).all() and (again.ids == tree.ids).all()
    vectors = np.array([r["embedding"] for r in brute.table(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")])
    assert covertree.Tree.of(np.floor(vectors * 256), np.arange(len(vectors))).depth > 3
    x, q = covertree.Tree.of(clustered, np.arange(4000)), covertree.Tree.of(clustered[::40], np.arange(0, 4000, 40))
    best = covertree.search(q, x, 5)
    assert best.looked < 0.4 * 100 * 4000
    score = (q.points @ x.points.T).astype(np.int64)
    for i in range(100):
        own = sorted((-s, p) for s, p in zip(score[i].tolist(), x.ids.tolist(), strict=True) if p != q.ids[i])[:5]
        assert [(-s, p) for s, p in zip(best.score[i].tolist(), best.id[i].tolist(), strict=True)] == own


def test_top_k_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(covertree, "DATA_BLOCK", 100)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 3) / 2]) for i in range(400)]
    rows[50] = (50, [0.0, 0.0, 0.0])
    rows += [(450, [0.5, 0.5, -0.5])]
    rows += [(1000, None), (1001, [1.0, None, 2.0]), (1002, [1.0, float("nan"), 2.0]), (1003, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in [*rows, (None, [1.0, 1.0, 1.0])]], "vec_id long, embedding array<double>, id string").repartition(4)
    found = covertree.top_k(df)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute.top_k(rows)
    assert covertree.top_k(df.limit(0)).count() == 0
    few = covertree.top_k(df.filter("vec_id in (0, 1, 2)"))
    assert few.count() == 2
    # numbers whose products exceed doubles and longs, and lengths that differ
    large = [(0, [2.0**40, 3.0]), (1, [2.0**40, 5.0]), (2, [1e300, 1.0]), (3, [2.0**33 + 1, 7.0]), (50, [1.0]), (51, [2.0]), (100, []), (101, [])]
    found = covertree.top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), scale=1.0)
    top, low = (1 << 63) - 1, -(1 << 63)
    expected = []
    for q, v in large:
        scores = [(-max(low, min(top, sum(int(a) * int(b) for a, b in zip(v, w, strict=True)))), i) for i, w in large if i != q and len(w) == len(v)]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:5])] if q % 50 == 0 else []
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == expected


# --- decontamination -----------------------------------------------------------------------------------------------


def test_contaminated(spark, docs):
    df, rows = docs
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench += [(9001, " ".join((rows[2][1] or "a").split()[:40])), (9002, None), (9003, ""), (9004, "three words here"), (None, "a b c d e f")]
    bench += [(9005, "w3"), (9006, "The"), (9007, " ".join((rows[2][1] or "a").split()[3:6])), (9008, "été"), (9009, ". - !")]
    items = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, doc_id long")
    found = {(r["doc_id"], r["item_id"], round(r["containment"], 9)) for r in contaminated(df, items).collect()}
    assert found == brute.contained(rows, [(i, t) for i, t in bench if i is not None])


def test_contaminated_in_blocks(spark, given, monkeypatch):
    from gridloom.llm import decontaminate

    df, rows = given
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 200)
    found = {(r["doc_id"], r["item_id"], round(r["containment"], 9)) for r in contaminated(df, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert found == brute.contained(rows, bench)


def test_contaminated_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert sorted(map(tuple, contaminated(odd[0], items).collect())) == [(2**60 + 7, 1, 1.0)] * 2
    assert contaminated(nothing, items).count() == 0
    assert contaminated(odd[0], items.limit(0)).count() == 0


# --- sharding ------------------------------------------------------------------------------------------------------


def test_shards(docs):
    df, rows = docs
    found = {r["doc_id"]: r for r in sharding.shard_documents(df).collect()}
    assert len(found) == len(rows)
    slots = {}
    for i, text in rows:
        raw, r = (text or "").encode(), found[i]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # id and number of shards decide, whatever the text
    again = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df.withColumn("text", F.lit("t")).repartition(7)).collect()}
    assert again == {i: r["shard"] for i, r in found.items()}


def test_shards_are_those_of_plain_rendezvous(spark):
    """The highest weighted draw of each id's shards, drawn by the hash that the column functions use."""
    n, ids = 7, spark.range(400).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 1.0, 4.0, 0.5, 1.0, 1.0]
    hashes = (F.xxhash64("doc_id", F.lit(k)).alias(f"h{k}") for k in range(n))
    for r in ids.select("doc_id", *hashes, sharding.rendezvous_shard(F.col("doc_id"), weights).alias("s")).collect():
        scores = [math.log((((r[f"h{k}"] % 2**64) >> 11) + 0.5) / 2**53) / weights[k] for k in range(n)]
        assert r["s"] == scores.index(max(scores))


def test_shards_follow_weights_and_move_little(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 4.0, 1.0]
    part = ids.select("doc_id", sharding.rendezvous_shard(F.col("doc_id"), weights).alias("s"), sharding.rendezvous_shard(F.col("doc_id"), [*weights, 2.0]).alias("g"))
    n = {r["s"]: r["count"] for r in part.groupBy("s").count().collect()}
    assert all(abs(n[k] / 40_000 - w / 8) < 0.01 for k, w in enumerate(weights))
    assert part.filter("g <> s and g <> 4").count() == 0
    assert abs(part.filter("g = 4").count() / 40_000 - 0.2) < 0.01


def test_shards_odd_rows(odd, nothing):
    found = sharding.shard_documents(odd[0]).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in odd[1])
    assert sharding.shard_documents(nothing).count() == 0


# --- lines ---------------------------------------------------------------------------------------------------------


def _lines_expected(rows):
    gone = brute.lines_gone([t for _, t in rows])
    out = []
    for d, (i, text) in enumerate(rows):
        lines = [] if text is None else text.split("\n")
        kept = None if text is None else "\n".join(x for n, x in enumerate(lines) if (d, n) not in gone)
        out.append((i, kept, len(lines), sum((d, n) in gone for n in range(len(lines)))))
    return out


def test_lines(docs):
    df, rows = docs
    rows = sorted((i, t) for i, t in rows if len(t or "") < 100_000)
    df = df.filter("text is null or length(text) < 100000")
    found = sorted(map(tuple, dedup_lines(df).select("doc_id", "text", "n_lines", "n_removed").collect()))
    assert found == _lines_expected(rows)


def test_lines_of_long_texts(spark):
    rng = random.Random(13)
    line = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    long = [line(60) for _ in range(600)]
    near = [x.replace(" v1", " w1", 2) if k % 3 else x for k, x in enumerate(long)]
    rows = [(1, "\n".join(long)), (2, "\n".join(near[::-1])), (3, line(40_000)), (4, "y" * 150_000), (5, "y" * 150_000 + "\n" + long[5])]
    assert all(len(t) > 100_000 for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, dedup_lines(df).select("doc_id", "text", "n_lines", "n_removed").collect()))
    assert found == _lines_expected(rows)


def test_lines_of_a_frequent_word_in_blocks(spark, monkeypatch):
    """Lines that share all words but one, of which more are posted than a block takes."""
    monkeypatch.setattr(linededup, "BLOCK", 40)
    monkeypatch.setattr(linededup, "LARGE", 8)
    rng = random.Random(14)
    rows = [(i, "\n".join(" ".join([*(f"c{k}" for k in range(rng.choice([2, 3, 9, 12]))), f"u{rng.randrange(40)}"]) for _ in range(3))) for i in range(120)]
    found = sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), chunk=300).select("doc_id", "text", "n_lines", "n_removed").collect()))
    assert found == _lines_expected(rows)


def test_lines_and_stage_with_clashing_columns(spark):
    import corpus_pipeline

    rows = [(1, "a b c\nd e f", "x", 7, 8, 0, None), (2, "a b c\ng", None, 7, 8, 0, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, n_removed int, n_lines int, uid long, n_chars int")
    assert sorted(map(tuple, dedup_lines(df).collect())) == [(1, "a b c\nd e f", 2, 0), (2, "g", 2, 1)]
    found = dict(corpus_pipeline.STAGES)["line_dedup"](spark, df, SF)
    assert found.columns == df.columns
    assert sorted(map(tuple, found.collect())) == [(1, "a b c\nd e f", "x", 7, 8, 0, 11), (2, "g", None, 7, 8, 0, 1)]


def test_lines_that_are_nearly_alike(spark):
    rng = random.Random(9)
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 12)):
            own = [f"t{k}" for k in range(rng.choice([3, 8, 9, 10, 20]))]
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"u{rng.randrange(6)}"
            rng.shuffle(own)
            lines.append(" ".join(own))
        rows.append((i, "\n".join(lines)))
    found = sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "text", "n_lines", "n_removed").collect()))
    assert found == _lines_expected(rows)


def test_lines_write_few_files(spark, monkeypatch):
    """What many tasks leave little of is gathered: files follow its size, not the number of tasks."""
    files, settle = {}, linededup.settle

    def counted(df, name="table", **how):
        out = settle(df, name, **how)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(linededup, "settle", counted)
    rng = random.Random(15)
    rows = [(i, "\n".join(" ".join(f"t{k}" if rng.random() < 0.9 else f"u{rng.randrange(6)}" for k in range(12)) for _ in range(5))) for i in range(160)]
    found = sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_lines", "n_removed").collect()))
    assert found == _lines_expected(rows)
    assert {name: files[name] for name in ("digests", "partners", "lines", "rest")} == dict.fromkeys(("digests", "partners", "lines", "rest"), 1)


def test_lines_odd_rows(odd, nothing):
    found = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in dedup_lines(odd[0]).collect() if r["text"] is not None)
    # repeated rows are one document, rows without an id stay and remove nothing
    assert found == sorted([("None", "a b c d e f g", 0), *[(str(2**60 + 7), "a b c d e f g", 0)] * 2, ("5", "", 0), ("6", "z", 0)])
    assert dedup_lines(odd[0]).count() == len(odd[1])
    assert dedup_lines(nothing).count() == 0


def test_hash_of_kept_bytes(spark):
    row = repeated_passages(spark.createDataFrame([Row(doc_id=1, text="é")])).first()
    assert row["kept_sha256"] == hashlib.sha256("é".encode()).hexdigest()


def test_lines_of_repeated_rows_in_separate_chunks(spark):
    """Rows equal in id and text are one document, whether or not they are posted together."""
    rows = [(7, "a b c d e\nf g h i j\na b c d e")] * 3 + [(3, "k l m n o")] * 2 + [(9, "f g h i j\np q r s t")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    expected = [(3, "k l m n o", 0)] * 2 + [(7, "a b c d e\nf g h i j", 1)] * 3 + [(9, "p q r s t", 1)] * 2
    for chunk in (8 << 20, 1):
        found = dedup_lines(df, chunk=chunk).select("doc_id", "text", "n_removed").collect()
        assert sorted(map(tuple, found)) == expected


def test_lines_with_several_partners_by_several_words():
    """The third line has the first as its likeliest partner and the second twice, by two words; it must stay open."""
    word, line = np.array([7, 7, 7, 8, 8], np.uint32), np.array([1, 2, 3, 2, 3])
    parity = np.where(line == 2, 3, 0).astype(np.uint64)
    columns = [word, line, line, np.zeros(5, np.int32), np.full(5, 20, np.uint32), word - 7, parity, 0 * parity]
    out = linededup._likeliest([linededup._pack(*columns)], 0, 0.8, False).set_index("uid")
    assert out.loc[3, "other_uid"] == 1 and out.loc[3, "more"]
    assert out.loc[2, "other_uid"] == 1 and not out.loc[2, "more"]


def test_words_hashed_in_pieces(monkeypatch):
    """Lines keep their numbers and word sets in pieces of any size, with white space and cases beyond ASCII."""
    texts = ["A a\u00a0B\n\n\u2003x\u3000\u0130 " + "long" * 9, "", "\u03a3\u03a3 \u4e2d\x1cz\x85Z\nE\u00c9\u00e9", "b a"]
    expected = [(d, k, len(linededup.words_of(x))) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if linededup.words_of(x)]
    for size in (1, 20, 1 << 19):
        monkeypatch.setattr(linededup, "PIECE", size)
        doc, line, n, word = linededup._joined(list(linededup._pieces(texts)))
        assert list(zip(doc.tolist(), line.tolist(), n.tolist(), strict=True)) == expected
        assert set(word[:2]) == set(word[-2:])


def test_stretches_in_pieces(monkeypatch):
    """Stretches and their hashes do not depend on the pieces in which they are made, and hold each passage once."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99 + 20 * (k % 2), n, np.uint8)) for k, n in enumerate([0, 49, 50, 700, 3, 51, 0, 900, 49])]
    data, offsets, found = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts]), []
    for size in (1, 64, 1 << 17):
        monkeypatch.setattr(suffix, "PIECE", size)
        start, end, doc, key = suffix.stretches(data, offsets, 50)
        found.append([x.tolist() for x in (start, end, doc, key, suffix.hashes_of(data, start, end))])
    assert found[0] == found[1] == found[2]
    passages = [(d, p) for a, b, d in zip(*found[0][:3], strict=True) for p in range(a, b - 49)]
    assert passages == [(d, offsets[d] + p) for d, x in enumerate(texts) for p in range(len(x) - 49)]


def _chunk_of_common_passage(n):
    """Documents that share a passage of 600 bytes between words of their own, as one chunk, and the passage's anchors."""
    rng = np.random.default_rng(4)
    common = rng.integers(97, 123, 600, np.uint8).tobytes()
    texts = [rng.integers(97, 123, 40, np.uint8).tobytes() + common + rng.integers(97, 123, 40, np.uint8).tobytes() for _ in range(n)]
    hot = np.sort(np.unique(suffix.stretches(np.frombuffer(common, np.uint8), np.array([0, 600]), 50)[3]))
    return texts, hot


def test_memory_of_a_common_passage():
    """A passage that very many documents of a chunk have takes no memory for each of its copies' bytes."""
    texts, hot = _chunk_of_common_passage(1200)
    data = np.frombuffer(b"".join(texts), np.uint8)
    payload = suffix._pack(np.arange(1200), np.ones(1200, bool), np.array([len(t) for t in texts]), data)
    tracemalloc.start()
    scan = suffix._Scan(payload, 50, hot, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(data)
    # the common passage goes without asking, but for that of the first document
    gone = np.zeros(len(data), bool)
    for a, b in zip(scan.start[scan.later], scan.end[scan.later], strict=True):
        gone[a:b] = True
    first, *others = [int(x.sum()) for x in np.split(gone, scan.offsets[1:-1])]
    assert first == 0 and min(others) >= 600


def test_common_passages_dealt_singly(spark, monkeypatch):
    texts, hot = _chunk_of_common_passage(60)
    monkeypatch.setattr(suffix, "_hot_anchors", lambda docs, width: hot)
    # also part of it, twice in one row, and copies
    own = [*(t.decode() for t in texts), texts[0][300:500].decode() * 2, texts[0][100:460].decode(), texts[1].decode()]
    rows = [(k * 7 % 64, t) for k, t in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_passages(df).collect()}
    assert found == brute.passages_removed(rows)
