"""Phrase mining, toxicity and ranked search against brute force, on small tables with odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import classifier, collocations, lexical, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ", fp string, c string, n string, w string, rank string, m string, terms string, score string, q string, phrase string, size string, a string, label string"
MORE = tuple("x" * 12)


def texts():
    r = random.Random(4)
    words = ["un", "deux", "trois", "new", "york", "city", "a", "é", "漢", "Ünder"]
    out = [None, "", " \t", ".,;", "new york city", "New York\x0bCity new\tyork  city", "a a a a a a a", "York-City new_york x2 2x", "ſÄ \x1c a\x85b a\xa0b"]
    out += [" ".join(r.choice(words) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(r.randint(1, 60))) for _ in range(420)]
    return out + ["new york city is long " * 3000, "z" * 30000, *out[5:30]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i % 31 == 7 else i, t, [None, "en", "fr", "und", "en"][i % 5]) for i, t in enumerate(texts())]
    rows += [rows[9], rows[9], rows[40]]
    return spark.createDataFrame([(*x, *MORE, "x") for x in rows], "doc_id bigint, text string, lang string" + CLASH)


def counted(docs, most):
    """lang -> (n, phrase -> count) by plain counting."""
    out = {}
    for d in docs.collect():
        n, f = out.setdefault(d["lang"] or "und", [0, Counter()])
        for piece in re.split("[.,;:!?\n-\r]", (d["text"] or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            out[d["lang"] or "und"][0] += len(w)
            f.update(" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    return out


def brute_collocations(docs, least, most, top):
    out = []
    for lang, (n, f) in counted(docs, most).items():
        found = []
        for phrase, a in f.items():
            w = phrase.split(" ")
            if a < least or len(w) < 2 or any(x[1] == a and len(x[0].split(" ")) > len(w) and f" {phrase} " in f" {x[0]} " for x in f.items()):
                continue
            score, k = min((1000 * a * n // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            found.append((-score, -a, phrase.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def test_collocations(docs, monkeypatch):
    plain = lambda df: sorted(tuple(r)[:8] for r in df.collect())
    got = plain(collocations.collocations(docs, least=12, top=60))
    assert got == brute_collocations(docs, 12, 5, 60) and len(got) > 80
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 64)  # blocks end inside texts
    monkeypatch.setattr(collocations, "MAX_BITS", 10)
    assert plain(collocations.collocations(docs, least=12, most_words=3, top=9)) == brute_collocations(docs, 12, 3, 9)
    assert collocations.report(docs.limit(0)).count() == 0


def test_collisions_are_split(spark):
    """Fingerprints that say nothing: the comparison with the text alone must tell phrases and languages apart."""
    rows = spark.createDataFrame([(i, f"aa b{i % 2} ccccccccc{i % 3}", "en" if i % 2 else "fr") for i in range(60)], "doc_id bigint, text string, lang string")
    real = collocations.Block.grams
    df = rows.select("doc_id", "text", "lang")
    want = {(r["lang"], r["phrase"], r["a"]) for r in collocations.phrase_counts(df, 5).collect()}
    block = collocations.Block([b"aa bb aa cc", b"aa bb"], [1, 1])
    at, first = np.array([0, 2, 4]), np.array([0, 0, 0])
    assert block.same(at, first, 2).tolist() == [True, False, True] and block.spelled(at, 2).to_pylist() == ["aa bb", "aa cc", "aa bb"]
    assert real(block, 2)[0] == real(block, 2)[4] and ("en", "aa b1", 30) in want and ("fr", "aa b0", 30) in want


def test_first_place(spark):
    rows = spark.createDataFrame([(9, "x. one two", "en"), (4, "y Z one  two", "en"), (None, "one two", "en")], "doc_id bigint, text string, lang string")
    got = {r["phrase"]: (r["a"], r["first_doc"], r["first_byte"]) for r in collocations.phrase_counts(rows, 1).collect()}
    assert got["one two"] == (3, 4, 4) and got["x"] == (1, 9, 0) and got[None][0] == 9


def brute_search(docs, items, top):
    term = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
    docs = [(d["doc_id"], Counter(re.findall(term, (d["text"] or "").translate(LOWER)))) for d in docs.collect()]
    docs = [x for x in docs if x[1]]
    N, L = len(docs), sum(sum(c.values()) for _, c in docs)
    out = []
    for item, text in items:
        asked = set(re.findall(term, (text or "").translate(LOWER)))
        weight = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1))) for t in asked if (df := sum(t in c for _, c in docs))}
        scored = []
        for i, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * N) // L
            s = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def test_lexical_search(docs, spark, monkeypatch):
    items = [(1, "New York, city"), (2, "a a a DEUX é"), (3, None), (4, "nothing-here"), (5, "2x x2 und Ünder 漢"), (6, "New York, city"), (7, "trois un deux new york city a")]
    bench = spark.createDataFrame([(*x, "s") for x in items], "item_id bigint, text string, score string")
    got = lambda top: sorted(map(tuple, lexical.search(docs, bench, top).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got(50) == brute_search(docs, items, 50)
    for rows, block in ((3, 1000), (512, 2)):  # small strata, then blocks of two queries
        monkeypatch.setattr(lexical, "STRATUM_ROWS", rows)
        monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
        assert got(4) == brute_search(docs, items, 4)
    assert lexical.search(docs.limit(0), bench).count() == 0 and lexical.search(docs, bench.limit(0)).count() == 0


def test_strata_are_left_out():
    """A stratum whose bound is under the last kept score is not scored, and nothing is lost."""
    import pyarrow as pa

    r = random.Random(3)
    rows = [(i, 50 + 40 * (i % 30), sorted(r.sample(range(12), 4))) for i in range(900)]
    table = pa.table({"doc_id": [x[0] for x in rows], "m": [x[1] for x in rows], "terms": pa.array([x[2] for x in rows], pa.list_(pa.int32())), "tfs": pa.array([[r.randint(1, 3) for _ in x[2]] for x in rows], pa.list_(pa.int32()))})
    weight = np.array([[r.randint(0, 900) for _ in range(12)] for _ in range(5)], float)
    engine = lexical.Search(weight, 10)
    engine.visit(list(lexical._strata(table)), table["doc_id"])
    for q in range(5):
        all_ = sorted((-sum(int(weight[q, t]) * (1000000000 * f // (1000 * f + 20 * m)) for t, f in zip(ts, fs)), i) for i, m, ts, fs in zip(*(table[c].to_pylist() for c in ("doc_id", "m", "terms", "tfs"))))
        assert engine.best[q] == [(-s, i) for s, i in all_[:10]]
    assert engine.skipped > 50


def kernel(a, b):
    """The gap-weighted kernel by enumeration, hashed as the operator hashes."""
    def features(s):
        out = Counter()
        for i in range(toxicity.WINDOW):
            for n, reach in toxicity.REACH.items():
                from itertools import combinations

                for rest in combinations(range(i + 1, i + reach), n - 1):
                    letters = [s[k] for k in (i, *rest)]
                    if 32 not in letters:
                        out[bytes(letters)] += toxicity.DECAY ** (rest[-1] - i + 1)
        return out

    x, y = features(a), features(b)
    return sum(v * y[k] for k, v in x.items())


def test_string_kernel():
    a, b, c = (s.ljust(toxicity.PAD).encode() for s in ("an idiot is h", "an idxiot is", "lovely words "))
    row, col, val = toxicity.kernel_rows([a, b, c])
    phi = np.zeros((3, toxicity.BUCKETS))
    np.add.at(phi, (row, col), val)
    for i, x in enumerate((a, b, c)):
        for j, y in enumerate((a, b, c)):
            assert phi[i] @ phi[j] == pytest.approx(kernel(x, y), rel=1e-4, abs=1e-5)
    assert kernel(a, b) > 10 * kernel(a, c)
    assert toxicity.squeezed(b"I.d-i o\tt  an I d i o t, a b") == b"idi o t an idiotab"
    weight = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    long = ("some words of a text " * 60000).encode()
    short = long[:4000]
    assert toxicity.best([long, short, b""], weight)[:2] == pytest.approx([toxicity.best([short], weight)[0]] * 2, rel=1e-3)


def test_toxicity(spark):
    r = random.Random(8)
    syllables = ["ti", "on", "ar", "le", "mo", "sa", "ne", "ri", "do", "pu", "ka", "en"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    insults = ["wretchoid", "gribbler", "zonkhead"]
    prose = lambda n: [word() + r.choice(["", "", ".", ","]) for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        words = prose(r.randint(5, 90))
        toxic = int(i % 5 == 0)
        for _ in range(toxic * r.randint(1, 3)):
            words.insert(r.randint(0, len(words)), r.choice(insults))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    extra = [(None, "gribbler", "x"), (5000, None, "x"), (5001, "", "x"), (5002, "ti on " * 50000 + "zonkhead " + "sa ne " * 50000, "x"), rows[0]]
    put = [w[:k] + "x" + w[k:] for w in insults for k in (3, 5)] + [".".join(w) for w in insults] + [" ".join(w) for w in insults] + [w[:4] + "-" + w[4:] for w in insults]
    extra += [(6000 + k, " ".join([*prose(20), w, *prose(20)]), "x") for k, w in enumerate(put)]
    docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (7777, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks)
    got = {x["doc_id"]: x["s"] for x in toxicity.score(docs, model, name="s").collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 900 + len(extra) - 1 and all(0 <= s <= 1 for s in got.values())
    wrong = [(i, got[i], dict(labels)[i]) for i in held if (got[i] >= toxicity.THRESHOLD) != bool(dict(labels)[i])]
    assert not wrong and len(held) > 100
    assert got[5000] == got[5001] < 0.5 <= got[5002]
    assert all(got[6000 + k] >= 0.5 for k in range(len(put)))
    again = toxicity.fit(docs, marks)
    assert np.array_equal(again.weight, model.weight)
    clean = toxicity.fit(docs, marks.where("toxic = 0"))
    assert max(x["score"] for x in toxicity.score(docs.select("doc_id", "text"), clean).collect()) < 1e-9
    assert toxicity.score(docs.limit(0).select("doc_id", "text"), toxicity.fit(docs.limit(0), marks.limit(0))).count() == 0


def test_windows_end_with_their_text():
    """Texts scored together score as each alone does."""
    r = random.Random(2)
    some = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 9))).encode() for _ in range(200)]
    weight = np.random.default_rng(5).normal(size=toxicity.BUCKETS).astype(np.float32)
    assert toxicity.best(some, weight) == pytest.approx([toxicity.best([t], weight)[0] for t in some], abs=1e-6)
    for t in some[:40]:
        data, _ = toxicity.stream([t])
        at = toxicity.places(data, weight).astype(float)
        assert toxicity.windows(at) == pytest.approx([at[i : i + toxicity.WINDOW].sum() for i in range(len(at))], abs=1e-5)


def test_long_texts_teach_quality(spark):
    """Labelled texts of any length teach: blocks of a long text have the features of the whole."""
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcdefé") for _ in range(r.randint(1, 9))) for _ in range(4000)).encode()
    buckets, counts = np.unique(classifier.features(*classifier.joined([text]))[0], return_counts=True)
    few = [classifier.shares(text, block) for block in (1 << 18, 5000)]
    order = np.lexsort((buckets, -counts))[: classifier.MOST_BUCKETS]
    assert set(few[0][0]) == set(buckets[order]) and few[0][1].sum() == pytest.approx(counts[order].sum() / counts.sum(), rel=1e-5)
    shared = len(set(few[0][0]) & set(few[1][0]))
    assert shared > 0.999 * len(few[0][0])  # bigrams of a word with itself at a block's border alone may differ
    rows = [(i, ("fine prose here and there " if i % 2 else "zzz qqq ") * (20_000 if i < 20 else 10)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")  # all of them long
    model = classifier.fit(docs, labels)
    got = {x["doc_id"]: x["score"] for x in classifier.score(docs, model).collect()}
    assert min(s for i, s in got.items() if i % 2) > max(s for i, s in got.items() if not i % 2)


def test_lessons_reach_the_driver_packed(spark, monkeypatch):
    words = np.random.default_rng(3).integers(0, 5000, (60, 400))
    texts = [(i, " ".join(f"w{w}" for w in words[i]) * (i != 5)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    seen, keep = [], classifier.train_on
    monkeypatch.setattr(classifier, "train_on", lambda parts, labels: seen.append((parts, labels)) or keep(parts, labels))
    model = classifier.fit(spark.createDataFrame(texts, "doc_id bigint, text string"), labels)
    parts, taught = seen[0]
    want = [classifier.shares(t.encode()) for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    assert len(parts) == len(want) and all(a.dtype == b.dtype and np.array_equal(a, b) for x, y in zip(parts, want) for a, b in zip(x, y, strict=True))
    assert 2 * parts.nbytes < sum(i.nbytes + s.nbytes for i, s in want)
    plain = keep(want, taught)
    assert np.array_equal(model.weight, plain.weight) and model.bias == plain.bias


def test_redaction_is_one_pass(spark, tmp_path):
    """16,000 secrets in one text, spans that overlap, and a ledger that tells a blob twice."""
    import time

    from tessera.llm import secrets

    assert secrets.without("abcdefghij", [(5, 7), (1, 3), (2, 4), (7, 8)], "*") == "a*e*ij" and secrets.without("ab", [], "*") == "ab" and secrets.without("é漢x", [(0, 1), (2, 3)], "#") == "#漢#"
    many = " ".join(f"token=abcdef{i:06d}" for i in range(16_000))
    docs = spark.createDataFrame([(1, many), (2, None), (3, "nothing"), (4, many)], "doc_id bigint, text string")
    ledger = secrets.update_ledger(docs, str(tmp_path / "ledger"))
    start = time.time()
    got = sorted(secrets.redact(docs, ledger.union(ledger)).collect())
    assert time.time() - start < 30 and [r["doc_id"] for r in got] == [1, 2, 3, 4]
    assert got[0]["text"] == got[3]["text"] and "abcdef" not in got[0]["text"] and got[0]["text"].count(secrets.PLACEHOLDER) == 16_000
    assert got[1]["text"] is None and got[2]["text"] == "nothing"
