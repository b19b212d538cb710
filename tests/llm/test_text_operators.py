"""Operators on single texts: BPE, token counts, personal data, chat, toxicity, quality, decontamination."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import bpe, chat, decontam, pii, quality, queries, token_counts, toxicity

TEXTS = st.lists(st.sampled_from([*"ab'sre 12.!\n\t-é漢😀́", "the", "'ll", "  "]), max_size=40).map("".join)
DOCS = "doc_id bigint, text string, lang string, n_chars bigint, score string, n_tokens string, spans int, `__x` int"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i, t, None, None, "s", None, 1, 2) for i, t in enumerate(texts, first)], DOCS)


ODD = [None, "", " ", "\n", "word", "word", "a" * 30_000, "x y " * 20_000, "é漢😀"]


@pytest.fixture(scope="module")
def trees():
    path, pattern = bpe.default_vocabulary()
    return [bpe.TreeCodec(path, pattern, *sizes) for sizes in ((1, 1, 1), (3, 2, 1), (7, 5, 2), (20, 16, 4))]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_tree_gives_the_librarys_ids(trees, text):
    for tree in trees:
        ids = tree.encode(text)
        assert ids == tree.library.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abtheinrs", min_size=1, max_size=80))
def test_tree_of_one_piece(trees, piece):
    for tree in trees:
        assert tree.piece(piece.encode()) == tree.library._encode_single_piece(piece.encode())


def test_every_token_follows_from_its_merges(trees):
    """What the proof for neighbouring tokens needs."""
    tree = trees[0]
    ranks = {b: i for i, b in enumerate(tree.bytes_of) if b}
    for token in random.Random(1).sample([b for b in tree.bytes_of if b], 3000):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            assert parts[best] + parts[best + 1] in ranks
            parts[best : best + 2] = [parts[best] + parts[best + 1]]


def test_bpe_frames(spark):
    frame = docs(spark, ODD)
    library = bpe.codec(*bpe.default_vocabulary()).library
    want = {i: library.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    got = bpe.round_trip(frame, with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want
    for r in got:
        assert r["n_tokens"] == len(want[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256((ODD[r["doc_id"]] or "").encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
    decoded = bpe.decode(bpe.encode(frame)).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in decoded} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.round_trip(frame.limit(0)).count() == 0


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    texts = [*ODD, "<s> </s> ▁x  y", " lead", "trail ", "a  b", "a ́b c"]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(model.encode(t or "")) and got[i]["n_bytes"] == len((t or "").encode())
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 4096)
    assert token_counts.count_tokens(docs(spark, ODD).limit(0)).count() == 0
    small = token_counts.Counter(token_counts.default_model(), part_chars=7, batch_bytes=20)
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "the", " ", "  ", "é", "▁", ".", "\n", "12", "́"]) for _ in range(rng.randint(0, 40)))
        assert small.counts([text]) == [len(model.encode(text))], text
    taken = []
    small.model = type("Model", (), {"encode": lambda self, batch, num_threads: taken.append(sum(len(t.encode()) for t in batch)) or [[0]] * len(batch)})()
    small.counts(["é" * 6] * 30)
    assert all(n <= 20 + 12 for n in taken)  # by bytes, not by characters


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-1234567890 +()%_é", max_size=70))
def test_base_spans(text):
    assert pii.base(text) == plain_base(text)
    own, every = pii.find(text)
    assert set(own) <= set(every)


@pytest.mark.parametrize(
    "text, found",
    [
        ("write to john.doe [at] example [dot] com now", [("email", "john.doe [at] example [dot] com")]),
        ("mail bob at example dot com please", [("email", "bob at example dot com")]),
        ("mail јоhn@еxample.com ok", [("email", "јоhn@еxample.com")]),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", [("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ")]),
        ("call +one two three four five six seven eight nine zero", [("phone", "+one two three four five six seven eight nine zero")]),
        ("j​oe@exa​mple.com", [("email", "j​oe@exa​mple.com")]),
        ("ip １９２.168.1.1 done", [("ip", "１９２.168.1.1")]),
        ("meet me at noon on the dot", []),
        ("one two three", []),
        ("", []),
    ],
)
def test_disguises_map_back(text, found):
    _, every = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in every] == found


@pytest.mark.parametrize(
    "text, found",
    [
        ("alice@example dot com", [("email", "alice@example dot com")]),
        ("to alice@example dot co dot uk now", [("email", "alice@example dot co dot uk")]),
        ("host 192 dot 168 dot 0 dot 1 is up", [("ip", "192 dot 168 dot 0 dot 1")]),
        ("host 192.168 DOT 0 dot 1 is up", [("ip", "192.168 DOT 0 dot 1")]),
        ("mail bob at mail.example dot com please", [("email", "bob at mail.example dot com")]),
        ("mail bob at example.com.", [("email", "bob at example.com")]),
        ("visit us at example.com or come at 10.am, we met at home.Then we left", []),
        ("version 3 dot 5 of it", []),
        (f"to a@{'x' * 90} dot example dot {'y' * 90} dot com.", [("email", f"a@{'x' * 90} dot example dot {'y' * 90} dot com")]),
        ("a@b.co and then foo dot bar", [("email", "a@b.co")]),
        ("the dot on the i", []),
    ],
)
def test_spoken_forms_pass_the_gate(text, found):
    ((_, _, every),) = pii._find_all(pa.array([text]))
    assert [(k, text[a:b]) for k, a, b in every] == found


PIECES = ["a", "bob", "x1", "example", "com", "10", "192", "168", "@", ".", "-", "+", " ", "  ", "\t", "\x0b", "\u2003", " at ", " dot ", " DOT ", "[at]", "(dot)", "< point >", " at mail.", "us", "ſeven", "one ", "fıve ", "zéro,", "NINE-", "é", "\u00ad", "а"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join))
def test_gate_loses_nothing(text):
    ((_, own, every),) = pii._find_all(pa.array([text]))
    assert (own, every) == pii.find(text)


def slow_transducer(text):
    """Rewriting one place at a time, with a list of (character, first source character, end): the plain form of the transducer."""
    cells = [(c, i, i + 1) for i, c in enumerate(text)]
    cells = [(new, a, b) for c, a, b in cells for new in ([pii._ONE[ord(c)]] if ord(c) in pii._ONE else [c]) if new]
    text_of = lambda: "".join(c for c, _, _ in cells)

    def replaced(low, high, new):
        return cells[:low] + [(c, cells[a][1], cells[b - 1][2]) for c, a, b in new] + cells[high:]

    for pattern, made in ((pii._STEP, pii.Transducer._of_words), (pii._NUMBER_DOT, lambda m: [(".", m.start(), m.end())])):
        for match in reversed(list(pattern.finditer(text_of()))):  # from the end, so that places before it stay
            if new := made(match):
                cells = replaced(match.start(), match.end(), new)
    at = 0
    while match := pii._SPOKEN_DOT.search(text_of(), at):
        low = match.start()
        while low and text_of()[low - 1] in pii._HOST_CHARACTERS:
            low -= 1
        if low and text_of()[low - 1] == "@":
            cells = replaced(match.start(), match.end(), [(".", match.start(), match.end())])
            at = match.start() + 1
        else:
            at = match.end()
    return text_of(), [a for _, a, _ in cells], [b for _, _, b in cells]


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_the_transducer_is_the_plain_one(text):
    fast = pii.Transducer(text)
    made, begins, ends = slow_transducer(text)
    assert (fast.text, fast.begins, fast.ends) == (made, begins, ends)


def test_many_spans_stay_linear():
    import time

    text = "a@b.co joe at example dot com " * 20_000
    began = time.perf_counter()
    own, every = pii.find(text)
    assert len(own) == 20_000 and len(every) == 40_000 and time.perf_counter() - began < 20


def test_pii_frames(spark):
    texts = [*ODD, "a@b.co and 1.2.3.4", "+1 (988) 555-2485", "4111 1111 1111 1111", "joe at example dot com"]
    got = {r["doc_id"]: r for r in pii.digests(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
    assert got[len(texts) - 1]["spans"] == "email:0:22"
    frame = docs(spark, texts)
    done = pii.redacted(frame)
    assert done.columns == frame.columns
    by = {r["doc_id"]: r["text"] for r in done.collect()}
    assert by[0] is None and by[9] == "<email> and <ip>" and by[12] == "<email>" and by[6] == texts[6]
    assert [len(r["base"]) for r in pii.detect(frame).where("doc_id = 9").collect()] == [2]


def test_chat_round_trip(spark):
    wild = ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<sep>", "<\\/s>", "[/INST][INST]", "", None, "é\n\r", "$1 \\1"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "a<s>b", None]), rng.choice(wild)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(99, 1, "user", "b"), (99, 1, "user", "a"), (99, 1, "user", "a"), (None, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    read = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t["role"], t["text"]) for t in read[conv]["turns"]] == [(r, x) for _, r, x in want]
        assert read[conv]["loss"] == [x for _, r, x in want if r == "assistant"]
        assert read[conv]["formatted"].count("</s>") == 1 + sum(a[1] != b[1] for a, b in zip(want, want[1:]))
    assert chat.format_conversations(frame.limit(0)).count() == 0


def labelled(spark, n=600):
    rng = random.Random(6)
    words = [a + b for a in ("an", "er", "th", "in", "or") for b in ("ti", "on", "ed", "al", "is", "us")]
    rows, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(("vilest", "wretch", "scoundrel"))
        if not good:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_classifiers_on_held_out_documents(spark):
    frame, labels = labelled(spark)
    learn = labels.where("doc_id % 3 <> 1")
    model = toxicity.fit(frame, learn.select("doc_id", "toxic"), may_learn=F.col("doc_id") % 3 != 1)
    got = toxicity.score(frame, model).join(labels, "doc_id").where("doc_id % 3 = 1").toPandas()
    assert ((got["score"] >= 0.7) == (got["toxic"] == 1)).mean() > 0.97
    got = quality.classify(frame, learn.select("doc_id", "quality")).join(labels, "doc_id").where("doc_id % 3 = 1").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97


def test_features_do_not_depend_on_blocks(spark):
    frame, labels = labelled(spark, 300)
    chosen = []
    for rows in ("10000", "1"):  # rows of a batch, and so of a block at most
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            chosen.append(toxicity.fit(frame, labels.select("doc_id", "toxic")).chosen.sorted.tolist())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert chosen[0] == chosen[1] and chosen[0]


def test_classifiers_without_labels_or_text(spark):
    frame = docs(spark, ODD)
    none = spark.createDataFrame([(None, None), (1, None), (77, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame, none.where("doc_id = 1"))
    got = toxicity.score(frame, model, name="__s")
    assert got.columns == [*frame.columns, "__s"] and {r["__s"] for r in got.collect()} == {0.0}
    got = quality.classify(frame, none.withColumnRenamed("toxic", "quality")).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.5}
    assert quality.classify(frame.limit(0), none.withColumnRenamed("toxic", "quality")).count() == 0
    assert np.isfinite(quality.matrix(pa.array(ODD))).all()


@pytest.mark.parametrize("prior", [None, 0.2])
def test_the_model_does_not_depend_on_partitions(spark, prior):
    frame, labels = labelled(spark, 400)
    frame = frame.unionByName(frame.limit(20))  # repeated rows
    made = [toxicity.fit(frame.repartition(n, "text"), labels.where("toxic = 1").select("doc_id", "toxic").repartition(n), prior=prior) for n in (1, 8, 64)]
    for other in made[1:]:
        assert other.chosen.sorted.tolist() == made[0].chosen.sorted.tolist() and other.weights.tolist() == made[0].weights.tolist() and (other.bias, other.prior) == (made[0].bias, made[0].prior)
    # without a label of 0 anywhere; a fifth of the text is toxic
    assert 0.1 < made[0].prior < 0.35 and len(made[0].chosen.sorted) > 0


def test_training_follows_the_plain_risk():
    """Every step against the risk written out for a dense matrix, with its slope by differences."""
    rng = np.random.default_rng(3)
    n, k, prior, steps, rate, decay = 30, 6, 0.3, 25, 0.1, 1e-4
    x = (rng.random((n, k)) < 0.4).astype(float)
    positive, unlabelled = (np.arange(n) < 9).astype(float), (np.arange(n) >= 7).astype(float)
    x[:9, 0] = 1

    def parts(theta):
        f = x @ theta[:-1] + theta[-1]
        mean = lambda of, loss: (of * loss).sum() / of.sum()
        lift = prior * mean(positive, np.log1p(np.exp(-f)))
        below = mean(unlabelled, np.log1p(np.exp(f))) - prior * mean(positive, np.log1p(np.exp(f)))
        return lift, below

    def slope(g, theta):
        return np.array([(g(theta + 1e-5 * e) - g(theta - 1e-5 * e)) / 2e-5 for e in np.eye(k + 1)])

    theta, m, v = np.append(np.zeros(k), np.log(prior / (1 - prior))), 0.0, 0.0
    turned, late = 0, []
    for step in range(1, steps + 1):
        up = parts(theta)[1] < 0
        turned += up
        d = slope(lambda t: -parts(t)[1], theta) if up else slope(lambda t: sum(parts(t)), theta)
        d = d + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        late += [theta] if step > steps // 2 else []
    rows, columns = np.nonzero(x)
    w, b = toxicity.train(rows, columns, positive, unlabelled, k, prior, steps, rate, decay)
    assert np.allclose(np.append(w, b), np.mean(late, axis=0), atol=1e-4)


def test_quality_scores_are_plain_densities(spark):
    """Means, shrunk covariances and log-densities written out, by general inverse and determinant."""
    frame, labels = labelled(spark, 300)
    frame = frame.unionByName(docs(spark, ODD).selectExpr("doc_id + 1000 AS doc_id", "text"))
    learn = labels.where("doc_id % 3 <> 1")
    got = {r["doc_id"]: r["score"] for r in quality.classify(frame, learn.select("doc_id", "quality")).collect()}
    rows = frame.collect()
    x = quality.matrix(pa.array([r["text"] for r in rows], pa.string())).astype(np.float32).astype(float)
    y = {r["doc_id"]: r["quality"] for r in learn.collect()}
    own = [x[[i for i, r in enumerate(rows) if y.get(r["doc_id"]) == c]] for c in (0, 1)]
    n = sum(map(len, own))
    pooled = sum(len(o) * np.cov(o.T) for o in own) / n
    logs = []
    for o in own:
        lean = max(quality.TO_POOLED, quality.DIM / (quality.DIM + len(o)))
        s = (1 - lean) * np.cov(o.T) + lean * pooled
        s = (1 - quality.TO_DIAGONAL) * s + quality.TO_DIAGONAL * np.diag(np.diag(s)) + quality.LEAST * np.eye(quality.DIM)
        d = x - o.mean(0)
        logs.append(np.log(len(o) / n) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    assert len(got) == len(rows) and np.allclose([got[r["doc_id"]] for r in rows], want, atol=1e-6)


def test_negative_risk_is_held_up():
    """With few unlabelled rows and a free feature for each, plain unbiased risk would go below zero; this one doesn't drive scores apart without end."""
    n = 40
    w, b = toxicity.train(np.arange(n), np.arange(n), np.r_[np.ones(10), np.zeros(30)], np.r_[np.zeros(10), np.ones(30)], n, 0.3)
    assert np.isfinite(w).all() and np.abs(w).max() < 50 and np.isfinite(b)


ITEM = "Once Alice bought 12 apples and 30 pears at the market for 5 dollars each, then gave Bob half of them today. How many apples does Alice have left over?"


@pytest.mark.parametrize(
    "text, found, changed",
    [
        (f"so {ITEM} yes", True, False),
        (ITEM.upper(), True, False),
        (ITEM.replace("Alice", "Maria").replace("12", "7").replace("30", "19").replace("dollars", "euros"), True, True),
        (ITEM.replace("12", "30"), False, False),  # two slots of the item fall into one
        (ITEM[:70], False, False),
        ("Nothing of it is here, although Alice and Bob and 12 are named.", False, False),
        ("", False, False),
        (None, False, False),
    ],
)
def test_templates(text, found, changed):
    items = decontam.prepare([7], [ITEM])
    got = list(decontam.matches(pa.array([text], pa.string()), items))
    assert bool(got) == found and (not found or got[0][4] == changed)


def test_short_items_need_their_values():
    items = decontam.prepare([1, 2, 3], ["What is 3 plus 4?", "", None])
    assert [m[:2] for m in decontam.matches(pa.array(["what is 3 plus 4", "what is 5 plus 4"]), items)] == [(0, 0)]


DENSE = "12 kg 7 m 30 s 5 km 9 cm 4 mg 8 ml 3 h"
SHORT = ["What is 3 plus 4?", DENSE, "Alice Bob", "word", "Name Ångström in 2 words", "What is 3 plus 4 plus 5?"]


@pytest.mark.parametrize(
    "text, found",
    [
        ("Well, what is 3 plus 4? 12 is wrong.", [0]),
        ("9 What is 3 plus 4 plus 5? I don't know.", [0, 5]),
        ("Well, what is 3 plus 5? 4 is wrong, what is 3.", []),
        (f"he noted 99 {DENSE} 17 and went", [1]),
        (f"he noted 99 {DENSE.replace('30', '31')} 17 and went", []),
        ("to Carol Alice Bob Dave", [2]),
        ("a word, a WORD, and words", [3]),
        ("so NAME ÅNGSTRÖM IN 2 WORDS", [4]),
        ("what is 3 plus", []),
    ],
)
def test_items_without_windows_inside_longer_texts(text, found):
    items = decontam.prepare(list(range(len(SHORT))), SHORT)
    column = pa.array(["4? and", "filler " * 30 + text + " filler" * 30, "what is 3 plus", text, None])
    got = [(row, item) for row, item, *_ in decontam.matches(column, items)]
    assert got == [(row, item) for row in (1, 3) for item in found]


def plain_template(words):
    """(type or word, value) of words without names: a run of numbers is one, a unit stands after a number."""
    numbers, units = set(decontam.NUMBERS.split()), set(decontam.UNITS.split())
    out = []
    for i, w in enumerate(words):
        number = w[0].isdigit() or w in numbers
        if number and out and out[-1][0] == "#":
            out[-1] = ("#", out[-1][1] + " " + w)
        elif number:
            out.append(("#", w))
        elif i and (words[i - 1][0].isdigit() or words[i - 1] in numbers) and w in units:
            out.append(("%", w))
        else:
            out.append((w, w))
    return out


def plain_found(text, item):
    """The rule written out: windows of an alignment, slots, and the two ways for items without windows."""
    words_, wanted = text.split(), item.split()
    t, q = plain_template(words_), plain_template(wanted)
    literal = lambda p: sum(k not in "#%" for k, _ in p)
    width = decontam.WIDTH
    starts = [i for i in range(len(q) - width + 1) if literal(q[i : i + width]) >= decontam.LITERALS]
    short = decontam.LITERALS < len(q) < width and decontam.LITERALS <= literal(q) < len(q)
    if short:
        starts, width = [0], len(q)
    for shift in range(-len(q), len(t)):
        places = [i for i in starts if 0 <= i + shift and i + shift + width <= len(t) and [k for k, _ in q[i : i + width]] == [k for k, _ in t[i + shift : i + shift + width]]]
        if starts and len(places) >= min(decontam.SHARE * len(starts), decontam.ENOUGH) and places:
            pairs = {(q[k][0], q[k][1], t[k + shift][1]) for p in places for k in range(p, p + width) if q[k][0] in "#%"}
            if len({p[:2] for p in pairs}) == len(pairs) == len({(p[0], p[2]) for p in pairs}):
                return True
    if not starts or short:
        return any(words_[i : i + len(wanted)] == wanted for i in range(len(words_) - len(wanted) + 1)) if wanted else False
    return False


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**9))
def test_templates_are_the_plain_ones(seed):
    """Lower-case texts without stops, so no names: items planted whole, in part, with other numbers, and with slots that fall together."""
    rng = random.Random(seed)
    vocabulary = ["ape", "bee", "cat", "dog", "elk", "7", "12", "30", "km", "kg", "two"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(rng.choice((1, 3, 6, 7, 9, 14, 40))) for _ in range(4)]
    texts = []
    for _ in range(5):
        text = some(rng.randint(0, 12))
        for item in rng.sample(items, 2):
            low = rng.choice((0, 0, rng.randint(0, len(item))))
            swap = {n: rng.choice(["7", "12", "30", "99"]) if rng.random() < 0.4 else n for n in ("7", "12", "30")}
            text += [swap.get(w, w) for w in item[low:]] + ["fox"] + some(rng.randint(0, 6))
        texts.append(" ".join(text))
    items = [" ".join(i) for i in items]
    got = {(row, item) for row, item, *_ in decontam.matches(pa.array(texts), decontam.prepare(list(range(len(items))), items))}
    assert got == {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if plain_found(t, item)}


def test_short_items_with_other_values():
    items = decontam.prepare([1], ["What is the price of 3 pears?"])
    found = [m[:2] + m[4:] for m in decontam.matches(pa.array(["So what is the price of 3 pears now", "What is the price of 12 pears", "what is the cost of 3 pears"]), items)]
    assert found == [(0, 0, False), (1, 0, True)]


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_decontamination_frames(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
    frame = docs(spark, [*ODD, f"x {ITEM} y", f"{ITEM} {ITEM}"])
    bench = spark.createDataFrame([(7, ITEM, 1), (8, None, 1), (9, "", 1), (10, "word", 1)], "item_id bigint, text string, doc_id int")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.find(frame, bench).collect()) == [(4, 10), (5, 10), (9, 7), (10, 7)]
    kept = decontam.clean(frame, bench)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 6, 7, 8]
    assert decontam.find(frame, bench.limit(0)).count() == 0 and decontam.clean(frame, bench.limit(0)).count() == 11 and decontam.find(frame.limit(0), bench).count() == 0


def test_a_large_benchmark_is_joined(spark, monkeypatch):
    """The hash join finds what the broadcast blocks find: whole, in part, with other values, short, and word for word."""
    rng = random.Random(8)
    items = [ITEM, *SHORT, "What is the price of 3 pears?", None, "", ITEM.replace("market", "fair")] + [" ".join(rng.choice(ITEM.split()) for _ in range(rng.choice((2, 6, 12, 50)))) for _ in range(30)]
    texts = [*ODD]
    for _ in range(60):
        item = rng.choice([i for i in items if i])
        low = rng.choice((0, 0, len(item) // 3))
        texts.append(f"{'filler ' * rng.randint(0, 9)}{item[low:].replace('12', rng.choice(('12', '77'))).replace('Alice', rng.choice(('Alice', 'Maria')))} and so on")
    frame = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, __t1 string")
    bench = spark.createDataFrame([(f"i{i % 40}", t) for i, t in enumerate(items)], "item_id string, text string").repartition(3)
    got = []
    for most in (64 << 20, 0):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
        kept = decontam.clean(frame, bench)
        assert kept.columns == frame.columns
        got.append((sorted(map(str, decontam.find(frame, bench).collect())), sorted(map(str, kept.collect()))))
    assert got[0] == got[1] and len(got[0][0]) > 30


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 10)
    frame = docs(spark, [ITEM, "two other words that make nine of them here"])
    bench = spark.createDataFrame([(7, ITEM), (8, "two other words that make nine of them here")], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.find(frame, bench).collect()) == [(0, 7), (1, 8)]
    assert decontam.clean(frame, bench).count() == 0


def test_queries_over_small_tables(spark):
    """Every query of the package runs and has its columns."""
    from pathlib import Path

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test data")
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    want = {
        "op1_toxicity_nnpu": {"doc_id", "held_out", "score", "predicted"}, "op2_pii_deobfuscation": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op4_quality_qda": {"doc_id", "held_out", "score", "predicted"}, "op5_bpe_round_trip": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op10_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    }
    for name, columns in want.items():
        got = queries.queries()[name](spark, d)
        assert columns <= set(got.columns) and got.count() == n
