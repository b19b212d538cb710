"""Operators on several rows: WARC revisits, n-gram join, NN-descent, components, and the pipeline."""

import base64
import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from eventloom.llm import decontam, embed_dedup, ngram_join, pii, toxicity, warc
from eventloom.llm.common import cut, runs, scratch, shared_dir, unused
from eventloom.llm.components import components
from eventloom.llm.hashing import shingle_sets


class Union:
    def __init__(self, nodes):
        self.of = {n: n for n in nodes}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 4), (7, None)]
    edges += [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(150)]
    rng.shuffle(edges)
    union = Union({x for e in edges if None not in e for x in e})
    for a, b in edges:
        if a is not None and b is not None:
            union.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: union.find(n) for n in union.of if n != 5000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_runs_span_batches():
    rows = sorted((random.Random(2).randint(0, 5), i % 2) for i in range(50))
    table = pa.table({"a": [r[0] for r in rows], "b": [r[1] for r in rows]}).sort_by([("a", "ascending"), ("b", "ascending")])
    got = [(g.column(0)[0].as_py(), g.column(1)[0].as_py(), g.num_rows) for g in runs(iter(table.to_batches(max_chunksize=7)), 2)]
    assert len(got) == len({g[:2] for g in got}) and sum(g[2] for g in got) == 50


# n-gram join


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_join(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    union = Union({i for i, _ in sets if i is not None})
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                union.join(i, j)
    return sorted(((i, len(s), None if i is None else union.find(i)) for i, s in sets), key=str)


def join_rows(spark, rows):
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, n bigint, component_id bigint")
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame).collect()), key=str)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, bases = text(60), [text(rng.randint(5, 120)) for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:
            t = list(rng.choice(bases))
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
        elif kind < 0.5:
            t = text(rng.randint(0, 30)) + passage + text(rng.randint(0, 30))
        elif kind < 0.7:
            t = list(bases[0])  # a hot group of copies
        else:
            t = text(rng.randint(0, 80))
        rows.append((i, rng.choice((" ", "\n", "  ")).join(t)))
    return rows


@pytest.mark.parametrize("block, chunk, each, hot", [(1 << 20, 1 << 19, 256, 17), (300, 500, 256, 17), (1 << 20, 500, 4, 17), (1 << 20, 1 << 19, 256, 4), (300, 500, 5, 3)])
def test_ngram_join_is_the_plain_one(spark, monkeypatch, block, chunk, each, hot):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "PACK_CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "LEAST_ROWS", min(each, 64))
    monkeypatch.setattr(ngram_join, "MOST_ROWS", each)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "FREQUENT", 8)
    rng = random.Random(block)
    rows = corpus(rng, 220)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "long " * 9000), (906, "long " * 9001), (None, "one two"), (None, None), (903, "one two"), (907, "alone"), (907, rows[0][1])]
    assert join_rows(spark, rows) == plain_join(rows)


def test_ngram_join_of_nothing(spark):
    assert join_rows(spark, []) == [] and join_rows(spark, [(1, None)]) == [(1, 0, 1)]


def test_bitmaps_lose_no_link():
    rng = random.Random(7)
    texts = [t for _, t in corpus(rng, 80) if t.strip()]
    sets, maps = [], []
    for _, found, at in shingle_sets(pa.array(texts)):
        data, where = ngram_join._bitmaps(found, at)
        for i in range(len(at) - 1):
            sets.append(set(found[at[i] : at[i + 1]].tolist()))
            maps.append(data[where[i] : where[i + 1]].tobytes())
    good = ngram_join.may_link(np.array([len(s) for s in sets]), maps, 75)
    for i, a in enumerate(sets):
        if any(100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets) if i != j):
            assert good[i]


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "x y z", 3), (4, None, 4), (5, "", 5), (None, "q", 6), (2, "x y z", 7), (6, "k l m n o p q r", 8)]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id bigint, text string, component_id bigint, __id string, __rank string")
    kept = ngram_join.representatives(frame)
    assert kept.columns == frame.columns and all(r["__id"] == "a" and r["__rank"] == "b" for r in kept.collect())
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 4, 5, 6, None], key=str)


# embeddings


def plain_links(rows, threshold=0.93):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[n] = x / np.linalg.norm(x)
    union = Union({r[0] for r in rows if r[0] is not None})
    links = defaultdict(int)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold:
                links[a] += 1
                links[b] += 1
                union.join(rows[a][0], rows[b][0])
    return {n: (links[n], None if r[0] is None else union.find(r[0])) for n, r in enumerate(rows)}


def vectors(seed, n=260, dim=16):
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.standard_normal(dim)
    for i in range(n):
        kind = rng.random()
        v = centre + rng.standard_normal(dim) * 0.12 if kind < 0.3 else rng.standard_normal(dim)
        if kind > 0.85 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) * 2 + rng.standard_normal(dim) * 0.05
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if kind > 0.3 else 0))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1002, rows[0][1], None), (1003, None, 1), (1004, [0.0] * dim, 1), (1005, [None, *[1.0] * (dim - 1)], 1), (1006, [float("nan"), *[1.0] * (dim - 1)], 1), (1007, [float("inf"), *[1.0] * (dim - 1)], 1), (1008, [], 1), (1009, [1.0, 2.0], 1), (1010, [2.0, 4.0], 1)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_nn_descent_finds_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "LEAST_BLOCK", block)
    monkeypatch.setattr(embed_dedup, "MOST_BLOCK", block)
    rows = vectors(block)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, n_links int")
    found, recalls = embed_dedup.search(frame)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()}
    want = plain_links(rows)
    assert recalls[-1] >= 0.9
    assert got == {rows[n][0]: (links, c, c == rows[n][0]) for n, (links, c) in want.items()}


@pytest.mark.parametrize("lost", ["isolated pairs", "everything"])
def test_what_descent_misses_is_compared_in_full(spark, monkeypatch, lost):
    """A hot class has nearly all links, so a recall by links doesn't show that the pairs besides it are lost."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    rows = [(i, centre + rng.standard_normal(64) * 0.05, 1) for i in range(110)]
    for i in range(110, 230, 2):
        v = rng.standard_normal(64)
        rows += [(i, v, 1), (i + 1, v + rng.standard_normal(64) * 0.1, 1)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    descend = embed_dedup._descend

    def lossy(*args):
        return descend(*args).where("a < 110 AND b < 110" if lost == "isolated pairs" else "false")

    monkeypatch.setattr(embed_dedup, "_descend", lossy)
    monkeypatch.setattr(embed_dedup, "TRIES", 1)
    found, recalls = embed_dedup.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert got == {rows[n][0]: x for n, x in plain_links(rows).items()} and recalls == [0.0, 1.0]


@pytest.mark.parametrize("broadcast, part", [(1 << 20, 256), (0, 24)])
def test_descent_finds_what_short_runs_of_a_large_label_miss(spark, monkeypatch, broadcast, part):
    """A label of thousands against brute force: runs alone see a small share of its pairs, rounds find the links, nothing is compared in full."""
    monkeypatch.setattr(embed_dedup, "BROADCAST", broadcast)
    monkeypatch.setattr(embed_dedup, "PART", part)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((120, 32))
    x = [rng.standard_normal((2200, 32)), *(c + rng.standard_normal((20, 32)) * 0.16 for c in centres), centres[0] + rng.standard_normal((400, 32)) * 0.1]
    twins = rng.standard_normal((300, 32))
    x = np.concatenate([*x, twins, twins + rng.standard_normal((300, 32)) * 0.15]).astype(np.float32)
    order = rng.permutation(len(x))
    x = x[order]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.93
    np.fill_diagonal(link, False)
    assert len(x) > 5000 and 2 * embed_dedup.RUN * embed_dedup.ORDERS * 2 < len(x) / 10
    frame = spark.createDataFrame([(i, v.tolist(), 4) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    start = set()
    with embed_dedup.Scratch(spark) as work:
        known, _ = embed_dedup.nodes(frame, work)
        for r in embed_dedup._joined(embed_dedup._start(known, range(embed_dedup.ORDERS), 0.926, 4, embed_dedup.BITS)).collect():
            start.add((min(r), max(r)))
    found, recalls = embed_dedup.search(frame)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert len(recalls) == 1 and recalls[0] >= 0.98
    assert len(start) < 0.8 * link.sum() / 2
    share = [got[i][0] / n for i, n in enumerate(link.sum(1)) if n]
    assert np.mean(share) >= 0.98 and max(share) <= 1
    for i in range(len(x)):
        assert got[i][0] <= link[i].sum() and (got[i][0] > 0 or got[i][1] == i)


def test_rows_of_one_id(spark):
    """Equal rows are one vector; other vectors of an id have links of their own, and the id ties them."""
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.01, 1.0], 1), (3, [1.0, 0.0], 2), (1, [1.0, 0.0], 2), (4, [5.0, 0.01], 2), (5, [-1.0, 0.0], 1), (6, [1.0, 0.0], 1)]
    found, _ = embed_dedup.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect())
    assert got == sorted([(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 2, 1), (1, 2, 1), (4, 2, 1), (5, 0, 5), (6, 1, 1)])


def test_nn_descent_of_nothing_and_of_null_ids(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert embed_dedup.search(spark.createDataFrame([], schema))[0].count() == 0
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.search(spark.createDataFrame(rows, schema))[0].collect()}
    assert got == {None: (0, None), 1: (1, 1), 2: (1, 1)}


# archives


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_revisits(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rng = random.Random(9)
    bodies = ["", None, "<p>a</p>", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é漢😀", "x" * 400_000, "\r\n\r\n", "one only"]
    rows = [(i, rng.choice(["http://a.b/", None, "x\r\ny"]), rng.choice(bodies[:-1]), 1) for i in rng.sample(range(1000), 60)] + [(2000, "u", bodies[-1], 1), (None, "u", "<p>a</p>", 1), (None, "u", "null only", 1)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, size int")
    path = scratch(spark, "warc-test")
    warc.write_archives(warc.resolve(frame), path)
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        original = first.get(html or "")
        revisit = original is not None and original != i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", original if revisit else None))
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {(r[2] or "") for r in rows}
    # a revisit names its original's address and when that was taken
    resolved = warc.resolve(frame)
    text = "".join(r[0] for r in resolved.where("original IS NOT NULL").select(warc.record()).collect())
    assert text.count("WARC-Refers-To-Target-URI: ") == text.count("WARC-Refers-To-Date: ") == resolved.where("original IS NOT NULL").count()
    of = {i: (url or "") for i, url, _, _ in rows if i is not None}
    assert all(r["original_url"] == of[r["original"]] for r in resolved.where("original IS NOT NULL").collect())


def test_pages_larger_than_an_archive(spark, monkeypatch):
    """Archives are about so large on average; what is larger is read all the same, in parts."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 10_000)
    rng = random.Random(4)
    bodies = ["".join(rng.choice("ab\r\n") for _ in range(n)) for n in (3, 50, 120_000, 7, 300_000, 0, 90)]
    frame = spark.createDataFrame([(i, "u", b) for i, b in enumerate(bodies)], "page_id bigint, url string, html string")
    path = scratch(spark, "warc-test")
    warc.write_archives(warc.resolve(frame), path)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, path, payloads=True).collect()}
    assert got == dict(enumerate(bodies))


def test_no_pages(spark):
    path = scratch(spark, "warc-test")
    warc.write_archives(warc.resolve(spark.createDataFrame([], "page_id bigint, url string, html string")), path)
    assert warc.read_archives(spark, path).count() == 0


def test_cut_archives_are_refused():
    text = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert [b for _, b in warc.records(iter([text[:10], text[10:], text]))] == [b"abcde"] * 2
    for bad in (text[:-6], text[:20], b"nonsense\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records(iter([bad])))


# the pipeline


def test_pipeline_against_plain_stages(spark):
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test data")
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "bpe"]
    kept = spark.read.parquet(f"{d}/documents.parquet")
    columns, left = kept.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = cut(stage(spark, kept, d))
        assert kept.columns == columns
        left[name] = {r["doc_id"]: r for r in kept.collect()}
    # 2: one of each group, by the plain join over what the first stage kept
    want = {i for i, _, c in plain_join([(i, r["text"]) for i, r in left["toxicity"].items()]) if i == c}
    assert set(left["ngram_jaccard"]) == want
    # 3: no benchmark item is left, word for word, and only documents with one are gone
    items = [(" ".join(re.findall(r"[^\W_]+", r["text"].lower()))) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    leaks = {i for i, r in left["ngram_jaccard"].items() if any(f" {x} " in f" {' '.join(re.findall(r'[^\W_]+', r['text'].lower()))} " for x in items)}
    assert set(left["decontamination"]) == set(left["ngram_jaccard"]) - leaks
    # 4: spans are gone
    for i, r in left["pii"].items():
        assert r["text"] == pii.redact(docs[i]["text"], pii.find(docs[i]["text"])[1]) and r["n_chars"] - docs[i]["n_chars"] == len(r["text"]) - len(docs[i]["text"])
    # 5: ids decode to the text
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(out) == set(left["pii"])
    assert all(out[i]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() and out[i]["n_tokens"] == len(out[i]["ids"]) for i, r in left["pii"].items())


def test_intermediate_tables_are_deleted(spark):
    """Of a join, only the result stays in the shared folder."""
    import os

    folders = lambda: {f for f in os.listdir(shared_dir(spark)) if f.startswith("cut-")}
    before = folders()
    out = ngram_join.join(spark.createDataFrame([(i, "a b c d e f") for i in range(5)], "doc_id bigint, text string"))
    assert len(folders() - before) == 1 and out.where("component_id = 0").count() == 5
    found, _ = embed_dedup.search(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], "vec_id bigint, embedding array<float>, label int"))
    assert len(folders() - before) == 2 and found.where("n_links = 1").count() == 2


def test_names_that_no_column_has():
    assert unused(["a", "__ID", "__id_"], "__id", "__id", "b") == ["__id__", "__id___", "b"]


def test_queries_give_what_sql_gives(spark):
    import duckdb

    from eventloom.llm import queries, sql

    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for path in d.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    for name, text in sql.oracle_sql().items():
        got, want = queries.queries()[name](spark, str(d)), con.sql(text)
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        plain = lambda rows, names: sorted(str([row[names.index(c)] for c in columns]) for row in rows)  # noqa: B023, E731
        assert plain(got.collect(), got.columns) == plain(want.fetchall(), list(want.columns)), name


def test_pipeline_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word", None), (None, "word two", "x")], "doc_id bigint, text string, __score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 AS n_chars", "'a' AS __chars", "'b' AS __id", "'c' AS __text", "'d' AS component_id", "'e' AS label")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    assert docs.count() == 4 and {r["__score"] for r in docs.collect()} == {"x", None} and {(r["__chars"], r["__id"], r["__text"]) for r in docs.collect()} == {("a", "b", "c")}
    assert decontam.clean(docs.limit(0), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
    assert toxicity.Model(None, np.zeros(0), 0.0).scores(pa.array(["a", None])).tolist() == [0.0, 0.0]
