"""Fill-in-middle, source divergence and toxicity: against brute force and held-out labels, and their defined
results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from vektral.llm import divergence, fill_middle, queries, toxicity
from vektral.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    rnd = random.Random(4)
    words = ["Der", "the", "É", "日本", "🙂", "naïve", "x", "été"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))), rnd.choice(["en", "de"]), rnd.choice("ab"), 1) for i in range(300)]
    more = ["", None, " \n\t", "a", "🙂", "has <P> in it", "<S>", "x<M>", "<P", "ends with <", "long é " * 60_000]
    rows += [(1000 + i, t, None if i % 2 else "en", None if i % 3 else "c", None) for i, t in enumerate(more)]
    return rows + rows[:5] + [(None, "no id at all", "en", "a", 3), (None, "nor here", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ["n", "form", "output", "h1", "spm", "term", "terms", "salt", "counts", "y", "score", "held_out"]})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# -- fill-in-middle


def middle_expected(doc_id, text, unit="char", marks=("<P>", "<S>", "<M>")):
    t = text or ""
    cut = {"char": r"[\s\S]", "line": r"\n|[^\n]+\n?", "word": r"^[ \t-\r]+[^ \t-\r]*[ \t-\r]*|[^ \t-\r]+[ \t-\r]*"}[unit]
    parts = re.findall(cut, t)
    if unit == "word":  # white space in front belongs to the first unit
        parts = re.findall(r"[ \t-\r]+(?=[^ \t-\r])|[ \t-\r]+$|[^ \t-\r]+[ \t-\r]*", t)
    assert "".join(parts) == t
    n = len(parts)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in marks) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}"
    return n, "psm", a, b - a, f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_middle_is_cut_and_restored(docs, unit):
    made = fill_middle.restore(fill_middle.fill_in_middle(docs, unit))
    got = Counter(tuple(r) for r in made.collect())
    assert got == Counter((i, *middle_expected(i, t, unit), t or "") for i, t, *_ in odd_rows())
    assert {f for _, _, f, *_ in got} == set(fill_middle.FORMS)


def test_middle_with_other_marks_shares_and_batches(spark, docs):
    marks = ("[[prefix]]", "[[suffix]]", "[[middle]]")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = fill_middle.fill_in_middle(docs, plain_per_cent=0, spm_per_cent=50, marks=marks)
        rows = fill_middle.restore(made, marks).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    texts = Counter((i, t or "") for i, t, *_ in odd_rows())
    assert Counter((r.doc_id, r.restored) for r in rows) == texts
    forms = Counter(r.form for r in rows)
    assert forms["plain"] == 1 + 1 and forms["spm"] > 60 and forms["psm"] > 60  # the null and the empty text


def test_middle_refuses_marks_that_run_into_each_other(docs):
    for marks in [("a", "a", "b"), ("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "x"), ("<P>x", "<P>", "y")]:
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, marks=marks)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, "paragraph")


def test_middle_of_nothing_and_nulls(spark, nothing):
    assert fill_middle.restore(fill_middle.fill_in_middle(nothing)).count() == 0
    rows = spark.createDataFrame([(None, "x"), ("psm", None), ("psm", "<P>a<S>c<M>b"), ("plain", "q")], "form string, output string")
    assert [r.restored for r in fill_middle.restore(rows.coalesce(1)).collect()] == [None, None, "abc", "q"]


def test_segments_longer_than_a_step(monkeypatch):
    monkeypatch.setattr(fill_middle, "STEP", 7)
    source = np.frombuffer(bytes(range(65, 115)), np.uint8)
    starts, lengths = np.array([3, 0, 10, 5, 49, 2]), np.array([2, 0, 30, 4, 1, 3])
    want = b"".join(source[s : s + n].tobytes() for s, n in zip(starts, lengths))
    assert fill_middle.gathered(source, starts, lengths).tobytes() == want


# -- source divergence


def divergence_expected(rows, min_docs, smooth=5, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + smooth) // (sum(c[x] for x in kept) + smooth * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:top], 1)}
    return out


@pytest.mark.parametrize(("min_docs", "top"), [(30, 50), (2, 2), (10**6, 50)])
def test_divergence(docs, min_docs, top):
    got = [tuple(r) for r in divergence.source_divergence(docs, min_docs=min_docs, top=top).collect()]
    want = divergence_expected(odd_rows(), min_docs, top=top)
    assert set(got) == want and len(got) == len(want)
    assert any(r[0] == "" for r in got)


def test_divergence_of_nothing_and_of_one_source(spark, nothing):
    assert divergence.source_divergence(nothing).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s", 1)], SCHEMA)
    assert divergence.source_divergence(one, min_docs=1).count() == 0


def test_divergence_of_large_counts_is_exact(spark):
    """Counts beyond those whose billionfold fits a long."""
    n = 10**13 + 7
    df = spark.createDataFrame([(n, 3 * n + 1, 40)], "c long, t long, v long")
    got = df.select(divergence._share(F.col("c"), F.col("t"), F.col("v"), 5).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (3 * n + 1 + 5 * 40)


# -- toxicity


def test_units_of_sentences():
    u = toxicity.units(["You i d i o t there. A mor*on, ok?\nNo", None, "", "x" * 100, "1. e.g. fine"])
    found = defaultdict(list)
    for s, name in zip(u.sentence, u.strings()):
        found[int(u.text[s]), int(s)].append(name.decode())
    lists = [(d, sorted(x)) for (d, _), x in sorted(found.items())]
    assert lists[0] == (0, sorted(["you", "i", "d", "i", "o", "t", "there", "idiot"]))
    assert lists[1] == (0, sorted(["a", "mor", "on", "ok", "mor*on"])) and lists[2] == (0, ["no"])
    assert [d for d, _ in lists][3:] == [3, 4, 4, 4] and all(len(x) <= toxicity.UNIT for x in lists[3][1])
    assert "".join(x[: toxicity.UNIT - toxicity.SPAN + 1] for x in lists[3][1]).startswith("x" * 80)
    many = toxicity.units(["w " * 95])
    assert max(Counter(many.sentence[:95].tolist()).values()) == toxicity.SENTENCE_WORDS


def plain_kernel(a, b):
    def spectrum(w):
        w, d = "^" + w, Counter()
        for i in range(len(w)):
            for k in range(i + 2, min(len(w), i + toxicity.SPAN)):
                for j in range(i + 1, k):
                    d[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return d

    x, y = spectrum(a), spectrum(b)
    norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return (sum(v * y[u] for u, v in x.items()) / norm) ** 3 if norm else 0.0


def test_kernel_against_the_definition():
    names = ["idiot", "stupid", "aaaaaa", "moron", "lovely"]
    marks = toxicity.Landmarks.of([n.encode() for n in names])
    words = ["idiot", "idxiot", "idiiot", "stupidity", "aaa", "ab", "b", "lov", "moronic", "unrelated"]
    length = np.array([len(w) for w in words])
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    for step in (3, 100):
        got = marks.kernels(raw, np.cumsum(length) - length, length, step=step)
        assert np.allclose(got, [[plain_kernel(w, n) for n in names] for w in words], atol=1e-6)
    beta = np.arange(5.0)
    assert np.allclose(marks.kernels(raw, np.cumsum(length) - length, length, beta), got @ beta, atol=1e-5)
    root = marks.root()
    k = np.array([[plain_kernel(a, b) for b in names] for a in names])
    assert np.allclose(root @ root.T @ k, np.eye(5), atol=1e-4)


@pytest.fixture(scope="module")
def insulted(spark):
    """Clean and toxic documents of invented words; ids beyond 5000 have no label."""
    rnd = random.Random(8)
    syllables = ["ka", "lo", "mi", "ter", "un", "des", "or", "pa", "vin", "gel"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    rows, labels = [], []
    for i in range(600):
        sentences = [[word() for _ in range(rnd.randrange(4, 12))] for _ in range(rnd.randrange(1, 8))]
        toxic = int(i % 4 == 0)
        if toxic:
            s = rnd.choice(sentences)
            s.insert(rnd.randrange(len(s)), rnd.choice(["blockhead", "wretch", "numbskull"]))
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + "."))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(rows), dict(labels)


@pytest.fixture(scope="module")
def machine(insulted):
    docs, labels, _, _ = insulted
    return toxicity.train(docs, labels, tied=24, others=8, penalty=16)


def test_toxicity_on_held_out_and_edited_insults(insulted, machine):
    docs, _, texts, y = insulted
    rows = toxicity.score_documents(docs, machine).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.98
    clean = [t for i, t in texts.items() if not y[i] and not machine.scores([t])[0] >= 0.5][:40]
    for insult in ["blockhead", "BLOCKHEAD!", "b l o c k h e a d", "b.l.o.c.k.h.e.a.d", "block*head", "w-r-e-t-c-h", "num_bskull", "blockhheads"]:
        edited = [f"{t} mi {insult} lo." for t in clean]
        assert np.mean(machine.scores(edited) >= 0.5) > 0.9, insult


def test_scores_depend_on_the_text_alone(spark, insulted, machine):
    _, _, texts, _ = insulted
    some = [texts[i] for i in range(0, 600, 7)] + ["", " \n", None, "wretch " * 50_000]
    one = np.array([machine.scores([t])[0] for t in some])
    known = toxicity.Known(500)  # begins again now and then
    together = np.concatenate([machine.scores(some[k : k + 9], known) for k in range(0, len(some), 9)])
    assert np.array_equal(one, together) and ((one >= 0) & (one <= 1)).all() and one[-1] > 0.5 and len(set(one[-4:-1])) == 1
    odd = spark.createDataFrame(odd_rows(), SCHEMA).withColumn("score", F.lit("clash"))
    got = toxicity.score_documents(odd, machine).collect()
    assert len(got) == len(odd_rows()) and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)


def test_toxicity_edges(spark, nothing, insulted):
    docs, labels, _, _ = insulted
    model = toxicity.train(docs, labels.filter("doc_id < 0"))
    assert toxicity.score_documents(nothing, model).count() == 0
    assert {r.score for r in toxicity.score_documents(docs.limit(3), model).collect()} == {0.5}
    ones = toxicity.train(docs, labels.withColumn("toxic", F.lit(1)))
    assert {r.predicted for r in toxicity.score_documents(docs.limit(3), ones).collect()} == {1}
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None), (10**9, 1)], labels.schema))
    again = toxicity.train(docs.unionByName(docs), twice, tied=24, others=8, penalty=16)
    texts = ["a wretch", "lovely", ""]
    assert np.array_equal(again.scores(texts), toxicity.train(docs, labels, tied=24, others=8, penalty=16).scores(texts))


def test_loss_falls_and_labels_held_out_are_not_read(insulted):
    docs, labels, _, _ = insulted
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x, tied=24, others=8, max_train=300, penalty=16) for x in (labels, flipped))
    assert np.array_equal(a.beta, b.beta) and (a.slope, a.offset) == (b.slope, b.offset)


def test_toxicity_query_on_its_table(spark):
    got = queries.QUERIES["op13_toxicity"](spark, SMALL).toPandas()
    assert len(got) == table(spark, SMALL, "documents").count()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    both = got.merge(table(spark, SMALL, "labels").toPandas(), on="doc_id")
    assert (both.predicted == both.toxic).mean() > 0.9


def test_logistic_is_a_minimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    v = np.array(toxicity._logistic(x, y))
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda v: -(t * np.log(1 / (1 + np.exp(-(v[0] * x + v[1])))) + (1 - t) * np.log(1 / (1 + np.exp(v[0] * x + v[1])))).sum()
    assert all(loss(v) < loss(v + d) for d in ([0.05, 0], [-0.05, 0], [0, 0.05], [0, -0.05]))


# -- extra columns through the stages of the pipeline


EXTRA = ["_k", "_size", "_id", "_times", "score", "predicted", "Score", "n_lines", "n_dropped", "component_id", "_least", "a.b"]


def test_stages_give_extra_columns_back(spark, tmp_path):
    import corpus_pipeline as C

    docs = table(spark, SMALL, "documents")
    names = [c for c in EXTRA if c != "Score"]
    marked = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names})
    for k, (name, stage) in enumerate(C.STAGES[:4]):
        plain = stage(spark, docs, SMALL)
        got = stage(spark, marked, SMALL)
        assert got.columns == marked.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in names), name
        assert Counter((r.doc_id, r.text, r.n_chars) for r in rows) == Counter((r.doc_id, r.text, r.n_chars) for r in plain.collect()), name
        assert k < 4
    last = C.STAGES[4][1](spark, marked, SMALL)
    assert last.count() == docs.count()


def test_mixed_documents_keep_clashing_columns(spark):
    from vektral.llm import mixing

    df = spark.createDataFrame([(i, "a b c " * (i + 1), "en", f"s{i % 3}", 7, f"k{i}", f"z{i}") for i in range(30)], SCHEMA + ", _k string, _size string")
    rows = mixing.mixed_documents(df).collect()
    assert rows and all((r._k, r._size) == (f"k{r.doc_id}", f"z{r.doc_id}") for r in rows)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in mixing.mixed_documents(df.drop("_k", "_size")).collect())


def test_every_passage_of_a_labelled_text_is_learned_from(spark):
    from vektral.llm import quality_mil

    filler = " ".join(f"w{k % 300}" for k in range(7000))
    rows = [(k, f"{filler} {'dreadful' if k % 2 else 'splendid'} {filler}" if k < 40 else f"{'dreadful' if k % 2 else 'splendid'} w{k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, (k + 1) % 2) for k in range(200)], "doc_id long, quality int")
    seen = []
    fit = quality_mil.fit
    try:
        quality_mil.fit = lambda bags, y, **kw: seen.append([len(b.x) for b in bags]) or fit(bags, y, epochs=1)
        quality_mil.train(docs, labels)
    finally:
        quality_mil.fit = fit
    assert max(seen[0]) == -(-14_001 // 60)
