"""Each operator against a brute-force version, on odd documents and on the smallest tables."""

import binascii
import heapq
import os
import random
import re

import numpy as np
import pytest
from odd import ODD, documents, empty, entropy_bits, kept_lines, near_classes, secret_spans, sha, shingle_set, words
from pyspark.sql import functions as F

import public_tokenizers
from tablesync.llm import ann, fingerprints, line_dedup, mixing, near_dedup, packing, secrets, token_counts, token_output, toxicity
from tablesync.llm.common import table
from tablesync.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"
PAIRS = [(d, t) for d, t, *_ in ODD]


@pytest.fixture(scope="module")
def small(spark):
    return table(spark, SF, "documents")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- line dedup ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup_odd(spark, batches):
    df = line_dedup.dedup_lines(documents(spark, extra=True), batches=batches)
    assert got(df, "doc_id", "n_lines", "n_dropped", "text") == sorted(kept_lines(PAIRS), key=repr)
    assert set(df.columns) == {*documents(spark, extra=True).columns, "n_lines", "n_dropped"} and got(df, "block") == [("own",)] * len(ODD)


def test_line_dedup_documents(spark, small):
    df = line_dedup.dedup_lines(small, min_docs=2, batches=3)
    assert got(df, "doc_id", "n_lines", "n_dropped", "text") == sorted(kept_lines(pairs_of(small), docs=2), key=repr)


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_runs_are_levelled_and_not_shuffled(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    lines = spark.range(400).selectExpr("id % 150 AS h1", "id % 7 AS h2", "id % 90 AS doc_id", "cast(id % 90 % 6 as int) AS batch")
    for b in range(6):
        runs.add(lines.where(f"batch = {b}"))
    assert sorted(r.level for r in runs.runs) == [1, 2]
    want = {}
    for r in lines.dropDuplicates(["h1", "h2", "doc_id"]).collect():
        want.setdefault((r["h1"], r["h2"]), set()).add(r["doc_id"])
    found = {(r["h1"], r["h2"]): r["max_doc"] for r in runs.common(3).collect()}
    assert found == {k: max(v) for k, v in want.items() if len(v) >= 3}
    index = spark.table(runs.runs[0].name).where("NOT seen").select("h1", "h2")
    new = lines.groupBy("h1", "h2").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = new.join(index.hint("merge"), ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
        merge = runs.common(3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange") == 1 and "Exchange" not in merge  # the batch's own
    runs.close()


# ---- mixing ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_schedule_is_less_than_a_block_away(spark, seed):
    rng = random.Random(seed)
    weights = {f"1s{i}": rng.choice([1, 2, 5, 40, 300, 0]) for i in range(rng.randint(1, 12))}
    parts = mixing.shares(spark.createDataFrame(list(weights.items()), "key string, weight long"), 60)
    plan = {r["key"]: r for r in mixing.schedule(parts).collect()}
    period = sum(r["share"] for r in plan.values())
    assert set(plan) == set(weights) and all(r["period"] == period for r in plan.values())
    assert sorted(s for r in plan.values() for s in r["slots"]) == list(range(period))
    for r in plan.values():
        for t in range(period + 1):
            assert abs(sum(s < t for s in r["slots"]) - t * r["share"] / period) < 1


def test_mix_keeps_every_row(spark, small):
    df = mixing.mix(small, spark.createDataFrame([("src0", 3.0), ("src1", 1.0), ("src2", None)], "source string, weight double"), block_rows=3, bucket_rows=4)
    rows = df.orderBy("slot", "pos").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in small.collect())
    assert len({(r["slot"], r["pos"]) for r in rows}) == len(rows) and all(0 <= r["pos"] < 3 for r in rows)
    assert all(len({r["source"] for r in rows if r["slot"] == s}) == 1 for s in {r["slot"] for r in rows})
    one = [r for r in rows if r["source"] == "src1"]
    assert [(r["block"], r["pos"]) for r in one] == [(i // 3, i % 3) for i in range(len(one))]


def test_mix_odd(spark):
    df = mixing.mix(documents(spark, extra=True), block_rows=2)
    assert df.count() == len(ODD) and got(df, "n_lines") == [("own",)] * len(ODD)
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.in_order(mixing.mix(documents(spark))).count() == len(ODD)


def test_mix_is_native(spark):
    plan = mixing.mix(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    assert 0 < len(model.buckets) < 20_000
    rows = toxicity.score(docs.join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0), model).collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert np.mean([x > y for x in toxic for y in clean]) > 0.95
    assert np.mean([x >= 0.5 for x in toxic]) > 0.7 and np.mean([x >= 0.5 for x in clean]) < 0.02


def test_toxicity_learns_nothing_held_out(spark):
    docs = documents(spark)
    ids = [d for d, *_ in ODD if binascii.crc32(str(d).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert ids and toxicity.training_rows(docs, labels, "doc_id", "text", toxicity.Settings()).count() == 0
    rows = toxicity.score(documents(spark, extra=True), toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(ODD) and all(r["score"] < 0.01 and r["predicted"] == 0 for r in rows)


def test_toxicity_drops_what_it_predicts(spark):
    words_ = [(i, f"text number {i} is " + ("awful" if i % 4 == 1 else "lovely") + f" w{i}", None, None, None) for i in range(400)]
    docs = spark.createDataFrame([*words_, (1000, None, None, None, None), (1001, "", None, None, None)], "doc_id long, text string, score int, predicted int, c0 int")
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(400)] * 2, "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 4 != 1} | {1000, 1001}
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0


def test_toxicity_empty_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.without_toxic(documents(spark), labels).count() == len(ODD)


# ---- token output ----------------------------------------------------------------------------------------------------

BPE = public_tokenizers.path("byte_bpe_50k.json")


def wanted_ids(rows):
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(BPE), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), binascii.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [1, 1000, 1 << 18])
def test_token_output_round_trip(spark, folder, block_ids):
    rows = [*PAIRS, (None, "no id"), (None, None)]
    path = folder("ids")
    token_output.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, BPE, 2, block_ids=block_ids)
    assert got(token_output.crc_of_ids(token_output.read_ids(spark, path)), "*") == sorted(wanted_ids(rows), key=repr)


def test_token_output_documents(spark, small):
    found = token_output.crc_of_ids(token_output.encode_documents(small, BPE, 2))
    assert got(found, "*") == sorted(wanted_ids(pairs_of(small)), key=repr)


def test_token_output_empty(spark):
    assert token_output.encode_documents(empty(spark), BPE, 2).count() == 0


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


@pytest.mark.parametrize("seed", range(5))
def test_code_lengths(seed):
    rng = np.random.default_rng(seed)
    counts = np.unique(np.exp(rng.uniform(0, 12, 200)).astype(np.int64)) if seed else 2 ** np.arange(30)
    lengths = token_output.code_lengths(counts, 40)
    assert (counts * lengths).sum() == huffman_cost(counts.tolist()) and (2.0**-lengths).sum() == 1
    limited = token_output.code_lengths(counts, 9)
    assert limited.max() <= 9 and (2.0**-limited).sum() <= 1 and (counts * limited).sum() >= (counts * lengths).sum()
    assert (counts * lengths).sum() < entropy_bits(counts.tolist()) + counts.sum()


@pytest.mark.parametrize("n", [1, 255, 256, 257, 3000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 60_000).astype("<u4")
    found, counts = np.unique(ids, return_counts=True)
    code = token_output.Code(found.astype(np.int64), token_output.code_lengths(counts))
    payload, marks = code.encode(ids)
    assert len(marks) == -(-n // token_output.CHECKPOINT)
    assert (code.decode(payload, marks, n, code.table()) == ids).all()
    # A stretch alone, from its checkpoint.
    assert (code.decode(payload, marks[-1:], n - (len(marks) - 1) * token_output.CHECKPOINT, code.table()) == ids[(len(marks) - 1) * token_output.CHECKPOINT :]).all()


# ---- near duplicates --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_groups(spark, small, k, percent):
    for rows in (PAIRS, pairs_of(small)):
        df = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent)
        assert got(df, "doc_id", "n_shingles", "component_id") == sorted(near_classes(rows, k, percent), key=repr)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in df.collect())


def test_near_groups_of_one_origin(spark, monkeypatch):
    """Many edits of one text: links, and pairs of shared bands that are no links, in buckets of several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(90):
        own = [w if rng.random() > rng.choice([0.005, 0.02, 0.05]) else f"e{rng.random()}" for w in base]
        rows.append((d, " ".join(own)))
    want = near_classes(rows, 3, 85)
    assert 5 < len({c for *_, c in want}) < 90
    df = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85)
    assert got(df, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_min_max_estimate():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(items[:2000]), np.sort(items[400:2400])
    signs = [(near_dedup.signature(a) == near_dedup.signature(b)).mean()]
    for shift in range(1, 20):
        x = near_dedup.signature(near_dedup.mix(a + np.uint64(shift)))
        signs.append((x == near_dedup.signature(near_dedup.mix(b + np.uint64(shift)))).mean())
    assert abs(np.mean(signs) - 2 / 3) < 0.04


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(60)] + [(b"x", b"y")], "a binary, b binary")
    found = {bytes(r["node"]): bytes(r["component"]) for r in near_dedup.components(links).collect()}
    assert found == {f"{i:03d}".encode(): b"000" for i in range(61)} | {b"x": b"x", b"y": b"x"}


def test_one_of_each(spark):
    docs = documents(spark, extra=True).unionByName(documents(spark, extra=True).where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    kept = near_dedup.one_of_each(docs)
    want = {d for d, _, c in near_classes(PAIRS, 5, 80) if d == c}
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [*want, None]))
    assert near_dedup.one_of_each(empty(spark)).count() == 0


def test_one_of_each_keeps_unique_texts_of_a_repeated_id(spark):
    long = [" ".join(f"{w}{i}" for i in range(40)) for w in "abc"]
    rows = [(1, long[0]), (5, long[0] + " more"), (5, long[1]), (5, long[1]), (6, long[2]), (6, None), (6, ""), (None, long[0])]
    kept = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(kept, "*") == sorted([(1, long[0]), (5, long[1]), (6, long[2]), (6, None), (6, ""), (None, long[0])], key=repr)


# ---- secrets -----------------------------------------------------------------------------------------------------------


def test_secrets(spark, small):
    for rows in ([(d, t, s) for d, t, _, s, _ in ODD], [tuple(r) for r in small.select("doc_id", "text", "source").collect()]):
        df = secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")))
        want = secret_spans(rows)
        assert got(df, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == sorted(
            ((d, n["assign"], n["access"], n["hex"], sha(",".join(base)), ",".join(spans))
             for (d, *_), (base, spans, n) in zip(rows, want.values(), strict=True)), key=repr)
    assert any("owned" in s for _, s, _ in secret_spans([(d, t, s) for d, t, _, s, _ in ODD]).values() for s in s)


def test_secrets_ownership(spark):
    key = "Zz9" * 43  # 129 characters
    texts = {
        "sample": [(f"copy {i} password=abcdefgh", "one") for i in range(25)],  # many texts of one owner
        "copied": [(f"see {key} here", f"o{i}") for i in range(30)],  # one text under many owners
        "own": [("a token=ijklmnop", None), ("b token=ijklmnop", None), ("c token=ijklmnop", "one")],
        "shared": [(f"{o} Qq7Qq7Qq7Qq7Qq7Qq7Qq7Qq7Qq7", o) for o in ("x", "y", "z")],  # a text in each of three owners
    }
    rows, at = [], {}
    for name, some in texts.items():
        at[name] = len(rows)
        rows += [(len(rows) + i, *r) for i, r in enumerate(some)]
    df = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = {r["doc_id"]: r["spans"] for r in df.collect()}
    facts = {name: [(s["n_repositories"], s["n_owners"], s["live"]) for s in found[i]] for name, i in at.items()}
    assert facts == {"sample": [(25, 1, False)], "copied": [(1, 30, True)], "own": [(3, 2, True)], "shared": []}
    assert found[at["copied"]][0]["end"] - found[at["copied"]][0]["start"] == 129
    counts = {r["doc_id"]: (r["n_live"], r["n_example"], r["most_repositories"], r["most_owners"]) for r in secrets.report(df).collect()}
    assert counts[at["sample"]] == (0, 1, 25, 1) and counts[at["own"]] == (1, 0, 3, 2) and counts[at["shared"]] == (0, 0, 0, 0)


def test_secrets_by_a_named_repository(spark):
    rows = [(i, "password=abcdefgh", f"o{i}", f"r{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    assert {r["spans"][0]["live"] for r in secrets.scan(df).collect()} == {True}
    assert {r["spans"][0]["live"] for r in secrets.scan(df, repository="repo").collect()} == {False}


def test_secrets_odd(spark):
    assert secrets.scan(documents(spark, extra=True)).count() == len(ODD)
    assert secrets.report(secrets.scan(empty(spark))).count() == 0
    plan = secrets.scan(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- packing -----------------------------------------------------------------------------------------------------------


def test_pack_is_best_fit():
    lengths = (4, 8, 16)
    rng = random.Random(1)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 16) for _ in range(rng.randint(1, 60))), reverse=True)
        bins, left = [], sum(sizes)
        for size in sizes:
            fit = [(cap - used, i) for i, (cap, used) in enumerate(bins) if cap - used >= size]
            if fit:
                bins[min(fit)[1]][1] += size
            else:
                cap = min((c for c in lengths if c >= size), key=lambda c: (packing.bin_cost(c) / max(size, min(c, left)), c))  # noqa: B023
                bins.append([cap, size])
            left -= size
        placed = packing.pack(sizes, lengths)
        for i, (_, used) in enumerate(bins):
            mine = [(n, o, s) for (b, n, o), s in zip(placed, sizes, strict=True) if b == i]
            assert sum(s for *_, s in mine) == used and {n for n, *_ in mine} == {min(c for c in lengths if c >= used)}
            assert [o for _, o, _ in mine] == [sum(s for *_, s in mine[:j]) for j in range(len(mine))]


def test_packing_documents(spark):
    lengths = (16, 64, 256)
    rows = packing.pack_documents(documents(spark, extra=True), lengths=lengths, group_pieces=40).collect()
    by_doc = sorted((r["doc_id"], r["start"], r["size"]) for r in rows)
    want = sorted((d, s, min(256, len(t or "") + 1 - s)) for d, t in PAIRS for s in range(0, len(t or "") + 1, 256))
    assert by_doc == want
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in held] == [sum(x["size"] for x in held[:i]) for i in range(len(held))]
        assert {r["bin_length"] for r in held} == {min(c for c in lengths if c >= sum(x["size"] for x in held))}
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_is_dense(spark, small):
    rows = packing.pack_documents(small).select("bin_id", "bin_length", "size").collect()
    room = sum({r["bin_id"]: r["bin_length"] for r in rows}.values())
    assert sum(r["size"] for r in rows) > 0.9 * room


# ---- nearest neighbours -----------------------------------------------------------------------------------------------


def brute(rows, asked, k):
    out = []
    for q, x in asked:
        near = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in rows if v != q)[:k]
        out += [(q, i + 1, v) for i, (_, v) in enumerate(near)]
    return sorted(out)


def test_ann_exact_with_factor_one(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(4)]) for i in range(700)]
    rows += [(1000 + i, [0.5, -1.0, 2.0, 0.25]) for i in range(60)]  # ties
    vectors = ann.usable(spark.createDataFrame(rows, "v long, e array<double>"), "v", "e")
    index = ann.build(vectors, shard_rows=300)
    found = ann.search(index, vectors.where("vec_id % 20 = 0"), k=7, factor=1.0, block_rows=16)
    want = brute(rows, [(v, x) for v, x in rows if v % 20 == 0], 7)
    assert got(found, "query_id", "rank", "vec_id") == sorted(want, key=repr)
    by_id = dict(rows)
    assert all(abs(r["score"] - sum(a * b for a, b in zip(by_id[r["query_id"]], by_id[r["vec_id"]], strict=True))) < 1e-12 for r in found.collect())


def test_ann_recall_of_the_query(spark):
    from tablesync.llm.queries import op8_ann

    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    names, matrix = np.array([v for v, _ in rows]), np.array([x for _, x in rows])
    found = {}
    for r in op8_ann(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for i in np.flatnonzero(names % 20 == 0):
        scores = matrix @ matrix[i]
        scores[i] = -np.inf
        hits.append(len(found[names[i]] & set(names[np.argsort(-scores)[:20]].tolist())) / 20)
    assert len(hits) == len(found) and np.mean(hits) >= 0.95


def test_ann_odd(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]),
            (100, [float("inf"), 1.0]), (120, []), (140, [1.0]), (160, [2.0, 1.0]), (None, [1.0, 1.0]), (7, [3.0, 3.0])]
    vectors = ann.usable(spark.createDataFrame(rows, "v long, e array<double>"), "v", "e")
    found = ann.search(ann.build(vectors), vectors.where("vec_id % 20 = 0"), k=20)
    assert got(found, "*") == [(0, 1, 7, 9.0), (0, 2, 160, 4.0), (160, 1, 7, 9.0), (160, 2, 0, 4.0)]
    none = ann.usable(spark.createDataFrame([], "v long, e array<float>"), "v", "e")
    assert ann.search(ann.build(none), none).count() == 0


# ---- token counts -----------------------------------------------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts(spark, small):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.unigram_scores(PIECES)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    price = dict(vocabulary)
    more = [(100, " "), (101, "  a  b "), (102, "▁▁ ▁"), (103, "日本語 テキスト"), (104, "<0x41>")]
    for rows in (PAIRS + more, pairs_of(small)):
        df = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PIECES)
        encoded = {i: library.encode(t or "", add_special_tokens=False).tokens for i, (_, t) in enumerate(rows)}
        assert got(df, "doc_id", "n_tokens") == sorted(((d, len(encoded[i])) for i, (d, _) in enumerate(rows)), key=repr)
        scores = {(r["doc_id"], r["text"]): r["token_score"] for r in df.collect()}
        for i, row in enumerate(rows):
            if not any(x.startswith("<0x") for x in encoded[i]):
                assert scores[row] == sum(price[x] for x in encoded[i])
    assert token_counts.count_tokens(empty(spark), PIECES).count() == 0
    assert token_counts.count_tokens(documents(spark, extra=True), PIECES).count() == len(ODD)


# ---- fingerprints -------------------------------------------------------------------------------------------------------


def slow_simhash(text):
    import xxhash

    from tablesync.llm.common import mix, odd_numbers

    hashes = [xxhash.xxh3_64_intdigest(w.encode()) for w in words(text)]
    counts = {}
    for seed, gram in enumerate(((0,), (0, 1))):
        factors = [int(x) for x in odd_numbers(len(gram), 7 + seed)]
        for i in range(len(hashes) - gram[-1]):
            total = (seed + sum(hashes[i + o] * f for o, f in zip(gram, factors, strict=True))) % 2**64
            term = int(mix(np.array([total], np.uint64))[0])
            counts[term] = counts.get(term, 0) + 1
    votes = [sum(n.bit_length() * (1 if t >> (63 - b) & 1 else -1) for t, n in counts.items()) for b in range(64)]
    return sum((v > 0) << (63 - b) for b, v in enumerate(votes))


@pytest.mark.parametrize("odd", [True, False])
def test_fingerprints(spark, small, odd):
    rows = [*PAIRS, (None, "no id")] if odd else pairs_of(small)
    found = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 4
        want.append((d, len(t), sha(t[: len(t) - cut] + after[:cut])))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=repr) == sorted(want, key=repr)
    by_id = {d: (t or "", order[(i + 1) % len(order)][1] or "") for i, (d, t) in enumerate(order)}
    for r in found:
        text, after = by_id[r["doc_id"]]
        assert r["fingerprint"] % 2**64 == slow_simhash(text)
        if r["doc_id"] != 16:
            other = fingerprints.simhash(after.encode())
            assert r["near_next"] == 1 - ((r["fingerprint"] % 2**64) ^ other).bit_count() / 64


def test_fingerprints_of_few(spark):
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == sha("abcdefab") and one[0]["near_next"] == 1
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0


def test_fingerprints_query_of_repeated_ids(spark, tmp_path):
    rows = [(100, "one two three"), (100, "one two three"), (100, "four five six"), (200, "one two three"), (None, None), (7, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = REGISTRY["op10_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_within_radius"]) for r in found) == [
        ("100", 1), ("100", 3), ("100", 3), ("200", 3), ("7", None), ("None", None),
    ]


@pytest.mark.parametrize("radius,blocks", [(3, 6), (0, 1), (2, 3), (5, 8)])
def test_within_radius(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    marks = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(6)] + [0, 1, 2**64 - 1]
    signed = [m - 2**64 if m >> 63 else m for m in marks]
    rows = spark.createDataFrame([(m,) for m in signed] + [(None,)], "fingerprint long")
    found = fingerprints.within_radius(rows, spark.createDataFrame([(m,) for m in signed[:60]], "fingerprint long"), radius, blocks)
    want = {(a, b, (a ^ b).bit_count()) for a, x in zip(signed[:60], marks, strict=False) for b in signed if ((a % 2**64) ^ (b % 2**64)).bit_count() <= radius}
    want = {(a, b, ((a % 2**64) ^ (b % 2**64)).bit_count()) for a, b, _ in want}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)


def test_shingles_agree():
    from tablesync.llm.common import shingles

    for _, text in PAIRS:
        for k in (3, 5):
            assert len(shingles((text or "").encode(), k)) == len(shingle_set(text, k))
