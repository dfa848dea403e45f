"""The training-data operators against SQL, brute force, round trips and held-out labels, and their
defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL, rows_of

from vektral.llm import ann_forest, bpe_fst, html_text, jaccard_join, line_dedup, mixing, near_embeddings, phrase_dedup, quality_mil, queries, token_files

WS = b" \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


# -- small tables with everything that may go wrong


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)] + ["É", "日本", "🙂"]
    passage = " ".join(rnd.choice(vocab) for _ in range(30))
    docs = []
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 40, 60]))]
        for _ in range(rnd.choice([1, 1, 2, 6, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            text = " ".join(w)
            if rnd.random() < 0.2:
                text = text.upper() + "\n" + passage
            docs.append(text + rnd.choice(["", "\n Footer line\t", "\n\n", "  x  "]))
    docs += ["", None, " \n\t ", "one", "One", "a b c d", "long " * 30_000, " ".join(f"u{i}" for i in range(20_000))]
    rows = [(i, t, "en", rnd.choice(["a", "a", "a", "b", "Z", None]), len(t or "")) for i, t in enumerate(docs)]
    rnd.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns named as an operator's own are."""
    names = ["n", "sig", "block", "key", "score", "predicted", "_hot", "n_lines", "size", "taken", "rank", "range", "v", "shard"]
    return df.withColumns({c: F.lit("clash") for c in names if c not in df.columns})


def texts():
    return {i: t for i, t, *_ in corpus()}


def near_expected(texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("large", "levels", "limit"), [(64, 2, 1000), (3, 1, 1000), (2, 2, 0)])
def test_jaccard_join(docs, large, levels, limit):
    got = jaccard_join.jaccard_join(clashing(docs), large=large, levels=levels, broadcast_limit=limit)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == near_expected(texts())


def test_jaccard_join_edges(spark, nothing):
    assert jaccard_join.jaccard_join(nothing).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (3, "A b  c d e F"), (None, None)]
    got = Counter(tuple(r) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, 2, 3): 1, (4, 2, 3): 2, (3, 2, 3): 1, (None, 0, None): 1})


def test_jaccard_join_repeated_ids_are_one_document(spark):
    t = [" ".join(f"{x}{i}" for i in range(20)) for x in "abc"]
    rows = [(1, t[0]), (2, t[0]), (2, t[1]), (3, t[1]), (4, t[2]), (5, t[2]), (5, None), (6, None)]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 16, 1), (2, 16, 1), (2, 16, 1), (3, 16, 1), (4, 16, 4), (5, 0, 4), (5, 16, 4), (6, 0, 6)]


@pytest.mark.parametrize("how", [{}, {"large": 4, "salt": 7, "rest": 0}, {"large": 4, "salt": 7, "levels": 1, "broadcast_limit": 0}])
def test_jaccard_join_one_passage_in_every_document(spark, how):
    """A passage that all documents share and little else, clusters of near copies among them."""
    rnd = random.Random(21)
    passage, rows = [f"p{i}" for i in range(60)], []
    for c in range(12):
        own = [f"c{c}_{i}" for i in range(rnd.choice([4, 9, 14]))]
        for _ in range(12):
            w = passage + own + [f"x{rnd.randrange(10**6)}" for _ in range(rnd.choice([0, 1, 3]))]
            if rnd.random() < 0.3:
                w[rnd.randrange(60)] = "changed"
            rows.append((len(rows), " ".join(w)))
    got = {r[0]: tuple(r)[1:] for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **how).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    up = list(range(len(rows)))
    link = [[j for j in range(len(rows)) if 100 * len(a & sets[j]) >= 80 * len(a | sets[j])] for a in sets]
    for _ in rows:
        up = [min(up[j] for j in link[i]) for i in range(len(rows))]
    assert len(set(up)) > 2 and got == {i: (len(sets[i]), up[i]) for i in range(len(rows))}


def test_jaccard_join_null_ids_bridge(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(words[:53] + [f"{x}{i}" for i in range(k)]) for x, k in (("x", 4), ("", 0), ("y", 9)))
    rows = [(5, a), (None, b), (2, c), (None, "only one of its kind is here"), (None, None), (8, "")]
    got = Counter(tuple(r) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {(i, n) for i, n, _ in got} == {(5, 53), (None, 49), (2, 58), (None, 3), (None, 0), (8, 0)}
    alone = jaccard_join.jaccard_join(spark.createDataFrame([r for r in rows if r[1] != b], "doc_id long, text string")).collect()
    assert {r[0]: r[2] for r in alone if r[0] in (2, 5)} == {2: 2, 5: 5}
    assert {(i, g) for i, n, g in got if n > 40} == {(5, 2), (None, 2), (2, 2)} and all(g == i for i, n, g in got if n < 40)


def test_pipeline_stage_tells_rows_apart(spark):
    import corpus_pipeline as C

    long = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(None, long), (None, long + " more"), (3, "a b c d e f"), (3, "a b c d e f"), (1, other), (6, other + " x"), (6, "a clean text of its own"), (None, None), (7, "")]
    got = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter(r[0] for r in got) == Counter({None: 2, 3: 1, 1: 1, 6: 1, 7: 1})
    assert {r[1] for r in got if r[0] == 6} == {"a clean text of its own"} and len([r for r in got if r[0] is None and r[1]]) == 1


def passages_expected(texts, k=13):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("per_block", [2000, 15])
def test_phrase_dedup(docs, per_block):
    got = phrase_dedup.remove_repeated_passages(clashing(docs), docs_per_block=per_block, digest=True)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == passages_expected(texts())


def test_phrase_dedup_one_passage_in_every_document(spark):
    """Blocks that all hold one passage, overlapping parts of others, a word repeated for long and a very long text."""
    rnd = random.Random(41)
    passage, other = [f"p{i}" for i in range(30)], [f"q{i}" for i in range(60)]
    texts = {}
    for k in range(70):
        own = lambda n: [f"r{rnd.randrange(10**6)}" for _ in range(n)]
        at = rnd.randrange(40)
        texts[k * 3] = " ".join(own(rnd.randrange(9)) + passage + own(5) + other[at : at + rnd.randrange(10, 20)] + own(rnd.randrange(9)))
    texts[1000], texts[1001] = " ".join(["same"] * 500), " ".join(["same"] * 12 + ["end"])
    texts[1002] = " ".join(f"w{k % 9000}" for k in range(60_000)) + " " + " ".join(passage)
    texts[1003] = " ".join(f"w{k}" for k in range(4000, 4100))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for per_block in (2000, 7):
        got = phrase_dedup.remove_repeated_passages(rows, docs_per_block=per_block, digest=True)
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == passages_expected(texts)


def test_phrases_are_located_by_words():
    """A document whose hashes say that it holds a phrase, but not its words, keeps them."""
    words = [f"v{k}" for k in range(20)]
    b = phrase_dedup.Block([1, 2], [" ".join(words), " ".join(words)], 13)
    phrases = phrase_dedup.Phrases(np.array([1]), [" ".join(words).encode()], 13, 4)
    at, holder = phrases.locate(b)
    assert len(at) == 16 and set(holder.tolist()) == {1}
    b.raws[1] = " ".join([*words[:10], "other", *words[11:]]).encode()  # the hashes stay as they were
    at, _ = phrases.locate(b)
    assert set(b.doc[b.at[at]].tolist()) == {0}


def test_automata_alone_locate_phrases(monkeypatch):
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([f"a{k}_{i}" for i in range(rnd.randrange(20))] + passage[k : k + 13 + rnd.randrange(15)] + [f"b{k}"]) for k in range(12)]
    b = phrase_dedup.Block(list(range(12)), texts, 13)
    expected = {(d, j) for d, t in enumerate(texts) for j in range(len(t.split()) - 12) if " ".join(t.split()[j : j + 13]) in " ".join(passage)}
    for per_machine in (1, 5, 1000):
        phrases = phrase_dedup.Phrases(np.array([3]), [" ".join(passage).encode()], 13, per_machine)
        at, holder = phrases.locate(b)
        assert Counter((int(b.doc[k]), int(k - b.begin[b.doc[k]])) for k in at) == Counter(expected) and set(holder.tolist()) == {3}
    monkeypatch.setattr(phrase_dedup.Phrases, "machines", lambda self: iter(()))
    assert len(phrases.locate(b)[0]) == 0


def test_phrase_dedup_edges(spark, nothing):
    assert phrase_dedup.remove_repeated_passages(nothing).count() == 0
    t = " ".join(map(str, range(20)))
    rows = [(5, t), (5, t), (None, t), (None, None)]
    got = Counter(tuple(r) for r in phrase_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 20, 0, t): 2, (None, 20, 20, ""): 1, (None, 0, 0, ""): 1})


def lines_expected(texts, least):
    key = lambda line: line.strip(WS).lower()
    lines = {i: (t or "").encode().split(b"\n") for i, t in texts.items()}
    n = Counter(k for ls in lines.values() for k in {key(x) for x in ls})
    out = {}
    for i, ls in lines.items():
        kept = [x for x in ls if not (key(x) and n[key(x)] >= least)]
        out[i] = (len(ls), len(ls) - len(kept), b"\n".join(kept).decode())
    return out


LIMITS = [{}, {"literal_limit": 0}, {"literal_limit": 0, "broadcast_limit": 0}]


@pytest.mark.parametrize("limit", LIMITS)
def test_line_dedup(docs, limit):
    got = line_dedup.dedup_lines(clashing(docs), min_docs=6, **limit)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == lines_expected(texts(), 6)


@pytest.mark.parametrize("limit", LIMITS)
def test_line_dedup_keeps_columns_named_as_its_own(docs, limit):
    given = clashing(docs).withColumn("_id", F.lit("clash"))
    got = line_dedup.dedup_lines(given, min_docs=6, **limit)
    assert set(given.columns) <= set(got.columns) and {(r["_hot"], r["_id"]) for r in got.collect()} == {("clash", "clash")}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == lines_expected(texts(), 6)


def test_line_dedup_edges(spark, nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0
    # a document is a doc_id: rows that repeat one count once, those without one for none
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "b"), (3, " A\n\tc"), (None, "a\nd"), (None, "c"), (2, None), (4, "")]
    expected = Counter({(1, "b", 2, 1): 2, (1, "b", 1, 0): 1, (3, "\tc", 2, 1): 1, (None, "d", 2, 1): 1, (None, "c", 1, 0): 1, (2, "", 1, 0): 1, (4, "", 1, 0): 1})
    for limit in LIMITS:
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, **limit).collect()
        assert Counter(tuple(r) for r in got) == expected


def test_line_dedup_of_a_very_long_text(spark):
    long = "\n".join(f"line {k % 7000}" for k in range(60_000))
    rows = [(1, long), (2, "line 3\nline x"), (3, "line 3")]
    for limit in LIMITS:
        got = {r[0]: tuple(r)[1:] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, **limit).collect()}
        n = sum(k % 7000 == 3 for k in range(60_000))
        assert got[2] == ("line x", 2, 1) and got[3] == ("", 1, 1) and got[1] == ("\n".join(x for x in long.split("\n") if x != "line 3"), 60_000, n)


def test_mixing(docs, nothing):
    got = mixing.mix_sources(clashing(docs), rows_per_range=7).collect()
    size = {i: len((t or "").encode().split()) for i, t in texts().items()}
    assert {r["doc_id"]: r["size"] for r in got} == size
    target = {r["source"]: r["target"] for r in got}
    total = {r["source"]: r["source_size"] for r in got}
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(total, key=lambda s: (s is None, (s or "").encode())))}
    level = max(target[s] / weight[s] for s in target)
    for s in target:
        assert target[s] <= 3 * total[s] + 1e-6 and (target[s] >= 3 * total[s] - 1e-6 or abs(target[s] / weight[s] - level) < 1e-6)
        assert sum(r["taken"] for r in got if r["source"] == s) == int(target[s])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix_sources(docs.repartition(3), rows_per_range=1000).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}
    assert mixing.mix_sources(nothing).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and abs(sum(size[r["doc_id"]] for r in mixed.collect()) - sum(target.values())) <= len(target) * max(size.values())


def mixed_by_hand(rows, target):
    """taken of each row (doc_id, size, source): the source's rows in the order of their keys, cut at the target."""
    out = []
    for s in {r[2] for r in rows}:
        mine = sorted((int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), i is not None, i or 0, n) for i, n, x in rows if x == s)
        total, left = sum(m[3] for m in mine), int(target[s])
        epochs = left // total if total else 0
        left -= epochs * total
        for _, has, i, n in mine:
            now = min(n, left)
            left -= now
            out.append((i if has else None, s, n, epochs * n + now))
    return Counter(out)


def targets_by_hand(rows):
    """Each source's target: shares of all words by weight, none above three times its size, the excess shared again."""
    total = Counter()
    for _, n, s in rows:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(total.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * total[s]}
        for s in full or open_:
            target[s] = 3.0 * total[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mixing_cuts_where_it_says(spark, monkeypatch):
    """Which documents the cut takes, with runs of ranges, repeated and null ids and copies over several tasks."""
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 7, rnd.randrange(500)]), " ".join(["w"] * rnd.randrange(9)), rnd.choice(["a", "a", "a", "b", None])) for _ in range(1500)]
    monkeypatch.setattr(mixing, "RUN", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for copies in (4096, 3):
        monkeypatch.setattr(mixing, "COPIES", copies)
        got = mixing.mix_sources(df, rows_per_range=20).collect()
        assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == mixed_by_hand([(i, len(t.split()), s) for i, t, s in rows], {r["source"]: r["target"] for r in got})


def test_mixing_edges(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (None, "c", None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) in (4, 5)


# -- tokens


def _tiktoken(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(3)
    parts = ["a", "the", "'s", "'t", " ", " ", "\n", "\t", "\xa0", "é", "日本", "🙂", "12", ".", "!!", "<|endoftext|>", "\x1c", "ing"]
    return ["", "a" * 3000, " " * 500, "=" * 300, "ab" * 2000, *("".join(rnd.choice(parts) for _ in range(rnd.choice([1, 4, 12, 60]))) for _ in range(600))]


def test_transducer_is_bpe():
    path = P.path("byte_bpe_50k.tiktoken")
    tokens = bpe_fst.load_ranks(path)
    library = _tiktoken({b: i for i, b in enumerate(tokens)})
    spelled = bpe_fst.Spelling(tokens)
    for states, room in ((400_000, 1 << 20), (50, 100)):  # the second: tables that start anew all the time
        mine = bpe_fst.TextEncoder(bpe_fst.BpeTransducer(tokens, states), P.PATTERN, room)
        every = odd_texts()
        for lo in range(0, len(every), 40):
            for t, coded in zip(every[lo : lo + 40], mine.encode(every[lo : lo + 40])):
                ids = np.frombuffer(coded, "<u2").tolist()
                assert ids == library.encode_ordinary(t)
                stream = bpe_fst.Utf8Stream(spelled)
                assert "".join(stream.feed([i]) for i in ids) + stream.close() == t


def test_digests_of_any_length(monkeypatch):
    tokens = bpe_fst.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = _tiktoken({b: i for i, b in enumerate(tokens)})
    every = odd_texts()
    ids = [library.encode_ordinary(t) for t in every]
    for run in (7, 1 << 18):  # the first: most documents are longer than a run
        monkeypatch.setattr(bpe_fst, "RUN", run)
        got = bpe_fst.Digests(tokens).of(np.array([i for x in ids for i in x]), np.cumsum([len(x) for x in ids]).tolist())
        for t, x, (a, b) in zip(every, ids, got):
            assert a == hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() and b == hashlib.sha256(t.encode()).hexdigest()


def test_chunks_keep_pieces():
    """Line feeds and spaces around the cuts: ids as the library's, whatever stands there."""
    tokens = bpe_fst.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = _tiktoken({b: i for i, b in enumerate(tokens)})
    mine = bpe_fst.TextEncoder(bpe_fst.BpeTransducer(tokens), P.PATTERN)
    every = ["".join(x) for n in range(1, 7) for x in itertools.product("a\n .", repeat=n)]
    for t, coded in zip(every, mine.encode(every)):
        assert np.frombuffer(coded, "<u2").tolist() == library.encode_ordinary(t), repr(t)


def test_bpe_query(docs, nothing):
    path = P.path("byte_bpe_50k.tiktoken")
    library = _tiktoken({b: i for i, b in enumerate(bpe_fst.load_ranks(path))})
    got = {r[0]: tuple(r)[1:] for r in bpe_fst.encode_documents(clashing(docs), path, P.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in texts().items():
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert bpe_fst.encode_documents(nothing, path, P.PATTERN).count() == 0


def test_token_files(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    files = token_files.write_token_files(clashing(docs), path, docs_per_file=20, block=100)
    got = {r[0]: tuple(r)[1:] for r in token_files.read_token_files(spark, files).collect()}
    start = 0
    for i, t in sorted(texts().items()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_token_files(spark, token_files.write_token_files(nothing, path)).count() == 0
    rows = spark.createDataFrame([(None, "a"), (2, None), (2, "b")], "doc_id long, text string")
    got = token_files.read_token_files(spark, token_files.write_token_files(rows, path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (2, 1), (2, 2)]


def test_library_encoder_is_the_library():
    e = token_files.LibraryEncoder(P.path("byte_bpe_50k.json"), 200)
    every = odd_texts() + ["word, other. again", "Word,\nother.", "it's, they're."] * 3
    for at in range(0, len(every), 50):
        part = every[at : at + 50]
        got = [np.frombuffer(x, e.kind).tolist() for x in e.encode(part)]
        assert got == [x.ids for x in e.library.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    import io

    rng = np.random.default_rng(bits)
    lengths = [0, 1, 7, 130, 64, 0, 300]
    ids = rng.integers(0, 1 << min(bits, 31), sum(lengths)).astype(np.uint32)
    f = token_files.TokenFile(io.BytesIO(b"".join(token_files.file_bytes(list(range(7)), lengths, ids, bits, 64))))
    at = 0
    for k, n in enumerate(lengths):
        assert (f.document(k) == ids[at : at + n]).all() and len(f.document(k)) == n
        at += n


# -- vectors


def vectors(n=300, dim=8, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:90] = x[50] + rng.normal(size=(40, dim)) * 0.02  # near copies
    x[100:110] = x[100]  # copies
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    return [*rows, (n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] * dim, 1), (n + 4, [], 1)]


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("shard", "block"), [(1000, 1000), (60, 70)])
def test_near_embeddings(spark, shard, block):
    rows = vectors()
    got = {r[0]: tuple(r)[1:] for r in near_embeddings.near_duplicates(clashing(spark.createDataFrame(rows, VECTORS)), shard_rows=shard, block_rows=block, beam=4).collect()}
    x = np.array([r[1] for r in rows[:300]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    up = list(range(300))
    for _ in range(300):
        new = [min([up[i], *(up[j] for j in np.flatnonzero(link[i]))]) for i in range(300)]
        if new == up:
            break
        up = new
    for i in range(300):
        assert got[i] == (int(link[i].sum()), up[i], up[i] == i)
    assert all(got[i] == (0, i, True) for i in range(300, 305))


def test_near_embeddings_audit_tests_links():
    """Queries of which few have links in the shard, and none of those that are evenly spaced."""
    rng = np.random.default_rng(8)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x = unit(rng.normal(size=(4000, 64)))
    q = unit(rng.normal(size=(3000, 64)))
    at = np.setdiff1d(np.arange(7, 3000, 10), np.linspace(0, 2999, 24).astype(int))
    q[at] = unit(x[at] + 0.2 / 64 * rng.normal(size=(len(at), 64)))
    truth = np.argwhere(q @ x.T >= 0.95)
    got = {(int(i), int(j)) for a, b in near_embeddings.Graph(x).links(q, 0.95, 1) for i, j in zip(a, b)}
    assert len(truth) > 200 and np.mean([(int(i), int(j)) in got for i, j in truth]) >= 0.99


def test_near_embeddings_of_any_size(spark):
    """Links planted among many others, and components that overflow or vanish when squared."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 32))
    pairs = [(i, i + 1500) for i in range(0, 200, 2)]
    for i, j in pairs:
        x[j] = x[i] + 0.1 * rng.normal(size=32)
    x[:2] *= 1e200
    x[1500:1502] *= 1e-200
    x[4] *= 1e-300
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(5000, [1e200, 1e200], 0), (5001, [1e200, 1.0001e200], 0), (5002, [1e-200, 1e-200], 0), (5003, [5e-324, -5e-324], 0)]
    got = {r[0]: tuple(r)[1:] for r in near_embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS), shard_rows=1000, block_rows=700).collect()}
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    assert all(link[i, j] for i, j in pairs)
    assert all(got[i][0] == link[i].sum() for i in range(3000)) and all(got[j][1] == min(i, j) for i, j in pairs)
    assert {i: got[i][0] for i in range(5000, 5004)} == {5000: 2, 5001: 2, 5002: 2, 5003: 0}


def test_near_embeddings_edges(spark):
    assert near_embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(7, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (9, [1.0, 0.01], 0), (3, [1.0, 0.0, 0.0], 0)]
    got = {r[0]: tuple(r)[1:] for r in near_embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {7: (2, 7, True), None: (2, 7, False), 9: (2, 7, False), 3: (0, 3, True)}


@pytest.mark.parametrize("shard", [1000, 90])
def test_nearest(spark, shard):
    rows = vectors(dim=16)
    df = clashing(spark.createDataFrame(rows, VECTORS))
    got = ann_forest.nearest(df, df.filter("vec_id % 20 = 0"), k=20, shard_rows=shard).collect()
    x = np.array([r[1] for r in rows[:300]])
    hits = 0
    for q in range(0, 300, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(x[q] @ x[v] - s) < 1e-9 for _, v, s in mine)
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(300), -score))[:20]
        hits += len(set(best.tolist()) & {m[1] for m in mine})
    assert hits >= 0.9 * 20 * 15
    assert not [r for r in got if r["query_id"] >= 300 or r["vec_id"] >= 300]


def test_nearest_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert ann_forest.nearest(empty, empty).count() == 0
    rows = spark.createDataFrame([(0, [1.0], 0), (2, [1.0], 0), (1, [1.0], 0), (None, [1.0], 0)], VECTORS)
    got = ann_forest.nearest(rows, rows.filter("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("n", [31, 69, 334, 335])
def test_nearest_keeps_ties_in_order(n):
    """Copies at odd places of matrices of odd heights: equal scores, smaller vec_id first."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 37))
    x[::3] = x[0]
    ids = rng.permutation(n)
    forest = ann_forest.Forest(x, ids, 4, 8)
    for near, score in forest.search(x[:20], ids[:20], 15, n):
        assert [tuple(t) for t in sorted(zip(-score, ids[near]))] == list(zip(-score, ids[near]))
        assert len({s for s, r in zip(score, near) if r % 3 == 0}) <= 1
    again = ann_forest.Forest(x, ids, grown=forest.stored())
    assert all((forest.candidates(q, 20) == again.candidates(q, 20)).all() and len(forest.candidates(q, 20)) >= 20 for q in x[:9])


def test_nearest_of_a_repeated_id(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (0, [0.0, 1.0], 0), (3, [2.0, 1.0], 0), (4, [1.0, 3.0], 0)], VECTORS)
    got = sorted(tuple(r) for r in ann_forest.nearest(rows, rows.filter("vec_id = 0")).collect())
    assert got == [(0, 1, 3, 2.0), (0, 1, 4, 3.0), (0, 2, 3, 1.0), (0, 2, 4, 1.0)]


def test_recall_on_the_table(spark):
    v = queries.table(spark, SMALL, "embeddings")
    rows = v.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), [r["vec_id"] for r in rows]
    got = queries.op4_approximate_neighbours(spark, SMALL).collect()
    hits = n = 0
    for k, q in enumerate(ids):
        if q % 20 == 0:
            score = x @ x[k]
            score[k] = -np.inf
            hits += len({ids[j] for j in np.argsort(-score)[:20]} & {r["vec_id"] for r in got if r["query_id"] == q})
            n += 20
    assert hits >= 0.9 * n


# -- pages and quality


@pytest.mark.parametrize(("page", "text"), [
    (None, ""),
    ("", ""),
    ("<html><head><title>x</title></head><body><nav><a>m</a></nav></body></html>", ""),
    ("<article><h1>T &amp; U</h1><p>a<br>b  c\n<p>Ti.</article><footer>f</footer>", "T & U\n\na b c\n\nTi."),
    ("<body><article><p>x</p><div class='comments'><p>nice</p></div><aside>s</aside><form><p>mail</p></form><p>y</article>", "x\n\ny"),
    ("<p>The <b>cat and the <i>dog</b> are in the house of the man</p><script>if (a<b) x</script><style>p{}</style>", "The cat and the dog are in the house of the man"),
    ("<article><p>1 &lt; 2 &#8364; &bogus; &amp;lt;</p></article>", "1 < 2 € &bogus; &lt;"),
    ("<!-- c --><article class='has-sidebar'><p>kept <!-- <p>no</p> --> here", "kept here"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_marks_keep_no_main_text_out():
    long = ("This is the text of the page, and it has a lot of words that are in the list of stop words. " * 3).strip()
    card = "<article><a href=x>Another story of the day</a></article>"
    assert html_text.main_text(f"<div><p>{long}</p><p>Short.</p><p>{long}</p></div>{card}") == f"{long}\n\nShort.\n\n{long}"
    assert html_text.main_text(f"<article><p>{long}</p><p>Zzz qqq.</p></article><div>{long}</div>") == f"{long}\n\nZzz qqq.\n\n{long}"
    assert html_text.main_text(f"<div>Outside</div><article><p>{long}</p><p>see <a>there</a></p></article><div><a>more</a></div>") == f"{long}\n\nsee there"
    assert html_text.main_text(card) == "Another story of the day"


def test_short_blocks_take_their_neighbours_label():
    long = "This is the text of the article, and it has a lot of words that are in the list of stop words. " * 3
    page = f"<div><p>Short one.</p><p>{long}</p></div><div><a href=x>link</a> <a>other link</a></div>"
    assert html_text.main_text(page) == "Short one.\n\n" + long.strip()


def test_pages_query(spark):
    got = queries.op9_html_extraction(spark, SMALL).collect()
    pages = {r["page_id"]: r["html"] for r in queries.table(spark, SMALL, "pages").collect()}
    assert len(got) == len(pages) and all(r["text"] == html_text.main_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_pages(empty).count() == 0


def test_pages_of_other_scripts_and_signs():
    russian = "Это длинный текст статьи, в котором много слов, и ни одно из них не стоит в списке частых слов. " * 4
    italian = "Questo testo racconta qualche storia breve senza parole frequenti nostre; ogni frase resta comunque leggibile. " * 3
    english = "This is the text of the page, and it has a lot of words that are in the list of stop words. " * 3
    spam = "Cheap watches, cheap bags, cheap shoes, best price, free shipping, order today, limited stock, discount " * 3
    for body in (russian, italian, f"{english}</p><p>{russian}"):
        expected = body.replace("</p><p>", "\n\n").replace(" \n", "\n").strip()
        assert html_text.main_text(f"<body><div><a href=/>home</a> <a href=/x>news</a></div><div><p>{body}</p></div></body>") == expected
    assert html_text.main_text(f"<div><p>{english}</p><p>{spam}</p></div>") == english.strip()
    assert html_text.main_text(f"<div class='legal-news'><p>{english}</p></div><div class='share-buttons'>{english}</div><div class='site-footer'>{english}</div>") == english.strip()
    links = "".join(f"<li><a href=/{k}>story number {k}</a></li>" for k in range(5))
    assert html_text.main_text(f"<main><p>{english}</p><p><a href=x>a link</a></p><p>{english}</p><ul>{links}</ul></main>") == f"{english.strip()}\n\na link\n\n{english.strip()}"


def test_pages_in_time_of_their_length():
    import time

    for page in ("<div>" * 80_000, "<a '" * 80_000, "<a '" * 80_000 + ">", "<div><b>" * 40_000 + "</b>" * 40_000, "<svg>" * 80_000, "<p><b>" * 40_000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 5


@pytest.mark.parametrize(("inside", "text"), [
    ("<header><h1>Title</h1></header><p>{long}</p>", "Title\n\n{long}"),
    ("<header class='site-header'><h1>Title</h1></header><p>{long}</p>", "{long}"),
    ("<p>{long}</p><figure><img src=x><figcaption>What the picture shows.</figcaption></figure><p>{long}</p>", "{long}\n\nWhat the picture shows.\n\n{long}"),
    ("<p>Press the <button type=button>Start</button> key and wait.</p><p>{long}</p>", "Press the Start key and wait.\n\n{long}"),
    ("<p>Press the <b>red</b> <button>Start</p><p>{long}</p></button><p>{long}</p>", "Press the red Start\n\n{long}\n\n{long}"),
    ("<p><button>Share</button></p><button>Print</button><p>{long}</p>", "{long}"),
    ("<p>It is <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>x=1</annotation></semantics></math> here.</p><p>{long}</p>", "It is x=1 here.\n\n{long}"),
])
def test_parts_of_an_article_are_kept(inside, text):
    long = ("This is the text of the page, and it has a lot of words that are in the list of stop words. " * 3).strip()
    page = f"<body><header><h1>Site</h1></header><nav><a href=/>home</a></nav><article>{inside.format(long=long)}</article><footer>f</footer></body>"
    assert html_text.main_text(page) == text.format(long=long)


def test_rules_decide_without_marks(spark):
    """The given pages with every mark of the article taken out still give nearly all of their blocks, and no other."""
    same = total = 0
    for page in [r["html"] for r in queries.table(spark, SMALL, "pages").select("html").collect()]:
        with_marks = Counter(html_text.main_text(page).split("\n\n"))
        without = Counter(html_text.main_text(re.sub(r"(?i)<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page)).split("\n\n"))
        assert not without - with_marks
        same, total = same + sum(without.values()), total + sum(with_marks.values())
    assert total and same >= 0.95 * total


def page_of_known_text(rnd):
    """A page put together from an article and what stands around it, and the article's text."""
    stop, own = "the of and to in is that it was for on are as with his they at be this have from".split(), [f"wo{c}d{d}" for c in "abcdefgh" for d in "xyz"]
    sentence = lambda n: " ".join(rnd.choice(stop if rnd.random() < 0.5 else own) for _ in range(n)).capitalize() + "."
    link = lambda: f'<a href="/{rnd.choice(own)}?a=1&b=2">{rnd.choice(own)} {rnd.choice(own)}</a>'
    expected, body = [], []
    for _ in range(rnd.choice([2, 5, 12])):
        kind = rnd.choice(["p", "p", "p", "h2", "ref", "inline", "br"])
        text = sentence(rnd.choice([40, 60, 90]))
        if kind == "ref":
            body.append(f"<p>{text} &amp; &lt;b&gt; &#233;</p>")
            text += " & <b> é"
        elif kind == "inline":
            body.append(f"<p>{text}\n <b>{own[0]}</b>\t<i>{own[1]}</i><!-- no --></p>")
            text += f" {own[0]} {own[1]}"
        elif kind == "br":
            body.append(f"<p>{text}<br>{own[2]}")
            text += f" {own[2]}"
        elif kind == "h2":
            expected.append(own[3])
            body.append(f"<h2>{own[3]}</h2><p>{text}</p>")
        else:
            body.append(f"<p>{text}</p>")
        expected.append(text)
    around = [f"<nav><ul>{''.join(f'<li>{link()}</li>' for _ in range(6))}</ul></nav>", f"<div class='sidebar'><p>{sentence(50)}</p></div>", f"<form><p>{sentence(30)}</p><input></form>", f"<script>var a = '<p>{own[0]}</p>';</script>", f"<div id=cookie-notice>{sentence(40)}</div>", f"<aside>{sentence(60)}</aside>", f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul>", f"<section class='comments'><p>{sentence(60)}</p></section>", f"<div class='ad'>{sentence(30)}</div>"]
    wrap = rnd.choice(["<article>{}</article>", "<div class='entry-content'>{}</div>", "<main>{}</main>", "<div><div>{}</div></div>"])
    before, after = rnd.sample(around, rnd.randrange(5)), rnd.sample(around, rnd.randrange(5))
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>{''.join(before)}{wrap.format(''.join(body))}{''.join(after)}<footer>f</footer></body></html>", "\n\n".join(expected)


def test_pages_against_known_texts(spark):
    """The operator on pages whose main text is known from how they were made, with odd rows among them."""
    rnd = random.Random(31)
    made = [page_of_known_text(rnd) for _ in range(300)]
    rows = [(k, f"u{k}", page) for k, (page, _) in enumerate(made)] + [(None, None, made[0][0]), (0, "u0", made[0][0]), (900, "x", None), (901, "x", "")]
    long = "<article>" + "<p>It is the same text of the page as before.</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([*rows, (902, "long", long)], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = html_text.extract_pages(pages).collect()
    want = Counter((i, u, made[i or 0][1]) for i, u, page in rows if page) + Counter({(900, "x", ""): 1, (901, "x", ""): 1})
    want[902, "long", "\n\n".join(["It is the same text of the page as before."] * 20_000)] += 1
    assert Counter((r["page_id"], r["url"], r["text"]) for r in got) == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_quality_classifier(spark, sf)
    y = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect()}
    rows = [(r["score"], y[r["doc_id"]], r["predicted"]) for r in got.collect() if r["held_out"] and r["doc_id"] in y]
    good, bad = [s for s, q, _ in rows if q == 1], [s for s, q, _ in rows if q == 0]
    assert np.mean([[a > b for a in good] for b in bad]) > 0.95
    assert np.mean([p == 1 for _, q, p in rows if q == 1]) > 0.95
    for r in got.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def score_by_hand(m, text):
    """One document's score, passage by passage in plain loops."""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    parts = quality_mil.passages([text], 60)
    assert len(parts.x) == max(1, -(-len(words) // 60)) and parts.count.tolist() == ([len(words[k : k + 60]) for k in range(0, len(words), 60)] or [0])
    hidden, energy, at = [], [], 0
    for x, n in zip(parts.x, parts.count.tolist()):
        mean = sum((m.e[w].astype(float) for w in parts.words[at : at + n]), np.zeros(quality_mil.SIZE)) / max(1, n)
        at += n
        h = np.tanh(np.clip((x - m.mean) / m.scale, -8, 8) @ m.w + mean @ m.p + m.b)
        hidden.append(h)
        energy.append(sum(m.a[j] * np.tanh(h @ m.v[:, j]) / (1 + np.exp(-(h @ m.u[:, j]))) for j in range(len(m.a))))
    weight = [np.exp(e - max(energy)) for e in energy]
    z = sum(w * h for w, h in zip(weight, hidden)) / sum(weight)
    return 1 / (1 + np.exp(-(z @ m.c + m.d[0])))


def test_quality_query_by_hand(spark):
    """The query's rows against the model's formula in plain loops, odd texts among them."""
    docs, labels = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels")
    model = quality_mil.train(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op10_quality_classifier(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        assert abs(r["score"] - score_by_hand(model, text[r["doc_id"]])) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)
    odd = ["", None, " \n\t", "x", "é 日本 🙂", "w " * 59, "w " * 61, "long word " * 40_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)] + [(3, "x")], "doc_id long, text string")
    for r in quality_mil.score_documents(rows, model).collect():
        assert abs(r["score"] - score_by_hand(model, odd[r["doc_id"]])) < 1e-5


def test_quality_learns_words():
    """Documents that differ in a few words of one passage only, alike in all that is counted."""
    rnd = random.Random(17)
    letters = "abcdefghij"
    plain, good, bad = (["".join(rnd.choice(letters) for _ in range(6)) for _ in range(n)] for n in (300, 12, 12))
    texts, y = [], []
    for k in range(900):
        w = [rnd.choice(plain) for _ in range(rnd.choice([120, 240]))]
        at = rnd.randrange(len(w) - 12)
        w[at : at + 12] = [rnd.choice(good if k % 2 else bad) for _ in range(12)]
        texts.append(" ".join(w))
        y.append(float(k % 2))
    bags = [p for t in texts for p in quality_mil.passages([t], 60).texts()]
    model = quality_mil.fit(bags[:700], np.array(y[:700]))
    score = model.scores(quality_mil.together(bags[700:]))
    assert np.mean((score > 0.5) == (np.array(y[700:]) > 0.5)) > 0.9


def test_quality_bounds_and_repeats(spark):
    long = quality_mil.passages(["a b c " * 10_000], 60)
    assert len(long.x) == 500 == len(long.count) and len(long.words) == long.count.sum() == 30_000
    rows = [(k, f"text number {k} of many") for k in range(60)] + [(5, "another text of five"), (5, "a third")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    one = quality_mil.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    two = quality_mil.train(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), labels)
    assert np.allclose(one.w, two.w) and np.allclose(one.e, two.e)


def test_quality_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_mil.train(docs, labels)
    got = quality_mil.score_documents(clashing(docs), model).collect()
    assert len(got) == len(texts()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_mil.score_documents(nothing, model).count() == 0
    assert quality_mil.train(nothing, labels).scores(quality_mil.passages(["a", "", None], 60)).shape == (3,)
    two = quality_mil.score_documents(spark.createDataFrame([(None, "same"), (1, "same")], "doc_id long, text string"), model).collect()
    assert two[0]["score"] == two[1]["score"]


def test_pipeline(spark, tmp_path):
    """Each stage against plain Python on what the stage before it left."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    first = {r["doc_id"]: r["text"] for r in kept[0]}
    assert first.items() <= start.items() and 0.5 * len(start) < len(first) <= len(start)
    assert {r["doc_id"]: r["text"] for r in kept[1]} == {i: t for i, (_, _, t) in lines_expected(first, 10).items()}
    groups = near_expected({r["doc_id"]: r["text"] for r in kept[1]})
    assert sorted(r["doc_id"] for r in kept[2]) == sorted(i for i, (_, c) in groups.items() if c == i)
    # the mix: targets by filling up, the cut by hand, documents as often as they are taken
    rows = [(r["doc_id"], len((r["text"] or "").encode().split()), r["source"]) for r in kept[2]]
    target = targets_by_hand(rows)
    times = Counter()
    for (i, _, n, taken), m in mixed_by_hand(rows, target).items():
        times[i] += m * int(taken / n + 0.5) if n else 0
    assert Counter(r["doc_id"] for r in kept[3]) == +times
    text = {r["doc_id"]: tuple(r[c] for c in ("text", "lang", "source")) for r in kept[2]}
    assert all(tuple(r[c] for c in ("text", "lang", "source")) == text[r["doc_id"]] for r in kept[3])
    # the tokens: ids, counts and digests as the library gives them
    library = _tiktoken({b: i for i, b in enumerate(bpe_fst.load_ranks(P.path("byte_bpe_50k.tiktoken")))})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter()
    for r in kept[3]:
        ids = library.encode_ordinary(r["text"] or "")
        expected[r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode()), tuple(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in kept[4]) == expected
    for rows in kept[:4]:
        assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    assert rows_of(C.run(spark, SMALL).toPandas()) == rows_of(docs.toPandas())


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and an empty table through every stage."""
    import corpus_pipeline as C

    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    good = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [(k, t, "en", "web" if k % 2 else None, len(t)) for k, t in enumerate(good)]
    rows += [(None, None, None, None, None), (None, "", "en", "web", 0), (None, good[0], None, "web", None), (3, good[3], "en", "web", len(good[3])), (3, good[3], "en", "web", len(good[3]))]
    rows += [(100, "", "en", "web", 0), (101, None, "en", "web", None), (102, " \n\t", None, None, 3), (103, " ".join(good) * 5, "en", "web", 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for k, (_, stage) in enumerate(C.STAGES):
            out = stage(spark, docs, SMALL)
            got = out.collect()
            assert k == 4 or out.columns == docs.columns
            if k == 0:  # rows stay or go whole
                assert not Counter(map(tuple, got)) - Counter(given)
            elif k == 1:
                assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r["doc_id"], r["source"]) for r in docs.collect()) and all(r["n_chars"] == len(r["text"]) for r in got)
            elif k == 4:
                assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect()) and all(r["n_tokens"] == len(r["ids"]) for r in got)
            if not given:
                assert not got
            if k < 4:
                docs = spark.createDataFrame(got, out.schema)


def test_forest_hands_leaves_out_by_their_margins():
    """What leaves the queue is what a heap over the nodes would hand out, and products rank as sums do."""
    import heapq

    rng = np.random.default_rng(3)
    x, ids = rng.normal(size=(700, 9)), np.arange(700)
    forest = ann_forest.Forest(x, ids, 5, 16)
    met, q = list(forest.met(x[:20], 150)), x[:20] / np.abs(x[:20]).max(1)[:, None]
    points = np.concatenate((q, np.zeros((20, 1))), 1).astype(np.float32)
    points *= forest.radius[0] / np.linalg.norm(points, axis=1, keepdims=True)
    margins = forest.normals @ points.T - forest.offsets[:, None]
    for i, (got, ways) in enumerate(zip(met, forest._queue(x[:20]))):
        heap, leaves = [(-np.inf, int(r)) for r in forest.roots], {}
        while heap:
            way, node = heapq.heappop(heap)
            if node < 0:
                leaves[-1 - node] = way
            else:
                side = float(margins[node, i])
                for child, far in zip(forest.children[node].tolist(), (side, -side)):
                    heapq.heappush(heap, (max(way, far), child))
        assert [leaves[j] for j in range(len(ways))] == ways.tolist() and list(leaves.values()) == sorted(ways)
        rows = lambda inside: {r for j in np.flatnonzero(inside) for r in forest.rows[forest.ends[j] - forest.lengths[j] : forest.ends[j]].tolist()}
        last = next(w for w in sorted(ways) if len(rows(ways <= w)) >= 150)
        assert rows(ways < last) <= set(got.tolist()) <= rows(ways <= last) and len(got) >= 150
    for q, i, (rows, score) in zip(x[:20], ids, forest.search(x[:20], ids[:20], 5, 700)):
        exact = (x * q).sum(1)
        exact[i] = -np.inf
        assert rows.tolist() == np.argsort(-exact, kind="stable")[:5].tolist() and (score == exact[rows]).all()
