import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import langid, lm, quality

from .data import words

WORDS = {"en": "the of and with thing other".split(), "es": "el niño de la acción más".split(), "ru": "это был новый день".split()}


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(240):
        g = rng.choice(sorted(WORDS))
        bad = i % 6 == 0
        text = " ".join(rng.choice(WORDS[g]) for _ in range(rng.randrange(5, 200)))
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, g, 0 if bad else 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(1000, None, None, None), (1001, "", "en", None), (1002, "1234 !!", "es", None), (1003, "the " * 30_000, "en", 1), (None, "the of", "en", 1)]
    return spark.createDataFrame(corpus() + odd, "doc_id long, text string, lang string, quality int").cache()


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_on_held_out_rows(spark, docs):
    net = quality.train(docs.drop("quality"), docs.select("doc_id", "quality"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.select("doc_id", "text", "score") if "score" in docs.columns else docs.select("doc_id", "text"), net).collect()}
    assert len(got) == 245 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == bool(q) for i, _, _, q in corpus() if held(i))


def test_quality_keeps_other_columns(spark, docs):
    net = quality.train(docs.drop("quality"), docs.select("doc_id", "quality"))
    odd = docs.select("doc_id", "text", F.lit("x").alias("_text"), F.lit(3).alias("score"), F.lit(1).alias("a.b"))
    got = quality.score(odd, net)
    assert got.columns == ["doc_id", "text", "_text", "a.b", "score"]
    plain = {r["doc_id"]: r["score"] for r in quality.score(docs.select("doc_id", "text"), net).collect()}
    assert {r["doc_id"]: (r["score"], r["_text"]) for r in got.collect()} == {i: (s, "x") for i, s in plain.items()}


def test_language_keeps_other_columns(spark, docs):
    odd = docs.select("doc_id", "text", F.lit("x").alias("_text"), F.lit(3).alias("score"), F.lit(1).alias("lang_pred"))
    got = langid.identify(odd, langid.train(docs), spans=False)
    assert got.columns == ["doc_id", "text", "_text", "lang_pred", "score"] and {r["_text"] for r in got.collect()} == {"x"}


def test_samples_are_bounded_where_an_id_repeats(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows: seen.append(rows))
    monkeypatch.setattr(langid, "fit", lambda rows: seen.append(rows))
    many = docs.unionByName(spark.range(20_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("z "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("quality")))
    quality.train(many.drop("quality"), many.select("doc_id", "quality"))
    langid.train(many)
    learned = sum(not held(i) for i, *_ in corpus())
    assert learned <= len(seen[0]) <= learned + 2 and learned <= len(seen[1]) <= learned + 6
    quality.train(many.drop("quality"), many.select("doc_id", "quality"), sample_bytes=2000)
    langid.train(many, sample_bytes=2000)
    assert 0 < sum(len(t) for t, _ in seen[2]) <= 2000 and 0 < sum(len(t.encode()) for _, t in seen[3]) <= 2000


def sigmoid_of_chunks(net, text):
    """The network's probability in plain Python."""
    windows = max(len(text) - quality.WIDTH + 1, 1) if text else 0
    padded, logit = text + bytes(quality.WIDTH), net.offset
    for begin in range(0, windows, quality.CHUNK):
        size = min(windows - begin, quality.CHUNK)
        small = math.log2(size) / math.log2(quality.CHUNK) - 1
        z = 0.0
        for f in range(quality.FILTERS):
            top = max(sum(float(net.table[j, padded[w + j], f]) for j in range(quality.WIDTH)) for w in range(begin, begin + size))
            z += max(top + float(net.bias[f]) + small * float(net.slope[f]), 0) * float(net.weight[f])
        logit += z * size / windows
    return 1 / (1 + math.exp(-logit))


def test_quality_probability_against_plain_python(spark, docs):
    net = quality.train(docs.drop("quality"), docs.select("doc_id", "quality"))
    texts = ["", "a", "abc", "the of and", "THE!! OF!! " * 40, "é🙂 " * 200, "plain " * 150]
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net)
    for r in got.collect():
        assert abs(r["score"] - sigmoid_of_chunks(net, texts[r["doc_id"]].encode())) < 1e-4


def test_word_scores_and_label_against_plain_python(spark, docs):
    from recollect.llm import _text as T

    m = langid.train(docs)
    text = "the niño это Other de этот 12 x"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, bounds = T.word_spans(data, np.array([0, len(data)]))
    low = T.LOWER[data]
    count, script = langid.letters(data, starts, ends)
    got = langid.word_scores(m, low, starts, ends, T.span_hashes(low, starts, ends), count, script)
    for w, word in enumerate(text.split()):
        n = sum(c.isalpha() for c in word)
        bucket, _ = langid._grams(low[starts[w] : ends[w]], np.array([0]), np.array([ends[w] - starts[w]]))
        kind = {"Other": 0, "the": 0, "niño": 0, "de": 0, "x": 0, "это": 2, "этот": 2}.get(word, -1)
        seen = [k for k in range(len(m.langs)) if kind >= 0 and m.scripts[kind, k]]
        for k in range(len(m.langs)):
            want = sum(float(m.logp[b, k]) for b in bucket) / len(bucket) * min(n, langid.LETTERS) - (50 if seen and k not in seen else 0) if n else 0.0
            assert abs(got[w, k] - want) < 1e-3
    label = langid.viterbi(got, bounds)
    letters = Counter()
    for k, n in zip(label, count):
        letters[m.langs[k]] += int(n)
    [r] = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), m, spans=False).collect()
    assert r["lang_pred"] == letters.most_common(1)[0][0] and abs(r["score"] - max(letters.values()) / sum(letters.values())) < 1e-9


def test_three_hundred_languages():
    scores = np.zeros((4, 300), np.float32)
    scores[:, 299] = 50
    assert langid.viterbi(scores, np.array([0, 4])).tolist() == [299] * 4


def test_quality_sees_the_whole_text(spark):
    rows = [(b"plain words here " * 5, 1), (b"plain words here " * 5 + b"%%%%%%%%", 0)] * 20
    net = quality.fit(rows)
    texts = [b"plain words here " * 3000, b"plain words here " * 20 + b"%%%%%%%%"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    both = net.logits(data, np.array([0, len(texts[0]), len(data)]))
    alone = [net.logits(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(both, alone, atol=1e-4) and both[0] > both[1]


def test_pooling_matches_plain_convolution():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 3, 4, 255, 259, 260, 1500)]
    data, offsets = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    pooled, at, doc, share, size = quality.pool(table, data, offsets, where=True)
    k = 0
    for d, t in enumerate(texts):
        windows = max(len(t) - quality.WIDTH + 1, 1) if len(t) else 0
        for lo in range(0, windows, quality.CHUNK):
            many = min(quality.CHUNK, windows - lo)
            after = np.concatenate([data[offsets[d] :], np.zeros(8, np.uint8)])
            r = np.array([sum(table[j, after[lo + p + j]] for j in range(quality.WIDTH)) for p in range(many)])
            assert doc[k] == d and np.allclose(pooled[k], r.max(axis=0), atol=1e-5) and abs(share[k] - many / windows) < 1e-9 and abs(size[k] - (math.log2(many) / 8 - 1)) < 1e-9
            k += 1
    assert k == len(doc)


def test_quality_without_labels(spark, docs):
    net = quality.train(docs.drop("quality"), docs.select("doc_id", "quality").limit(0))
    assert {r["score"] for r in quality.score(docs.select("doc_id", "text"), net).collect()} == {0.5}
    assert quality.score(docs.limit(0), net).collect() == []


def test_language_of_held_out_rows(spark, docs):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    assert all(got[i]["lang_pred"] == g and got[i]["score"] > 0.9 for i, _, g, _ in corpus() if held(i))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["lang_spans"] == [] for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "en"


def test_spans_of_mixed_text(spark, docs):
    model = langid.train(docs)
    a, b = " ".join(WORDS["en"] * 8), " ".join(WORDS["ru"] * 8)
    row = langid.identify(spark.createDataFrame([(1, a + " " + b)], "doc_id long, text string"), model).first()
    spans = [(s["lang"], s["start"], s["end"]) for s in row["lang_spans"]]
    assert spans == [("en", 0, len(a)), ("ru", len(a) + 1, len((a + " " + b).encode()))]


def test_letters_are_those_of_unicode():
    import unicodedata

    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    got = langid.letter_scripts(np.frombuffer(text.encode(), np.uint8))
    begins = np.cumsum([0, *(len(c.encode()) for c in text)])[:-1]
    want = np.array([unicodedata.category(c)[0] == "L" for c in text])
    assert ((got[begins] >= 0) == want).all() and (got >= 0).sum() == want.sum()
    script = lambda c: langid.SCRIPTS[langid.letter_scripts(np.frombuffer(c.encode(), np.uint8))[0]]
    assert [script(c) for c in "aéʃＡạ"] == ["latin"] * 5
    assert [script(c) for c in "ωжﺍא漢あ한ⰀⲀ"] == ["greek", "cyrillic", "near_east", "near_east", "east_asian", "east_asian", "hangul", "other", "other"]


def test_texts_without_letters_have_no_language(spark, docs):
    rows = [(1, "😀😀 🎉🎉🎉"), (2, "。、「」 。。"), (3, "ｔｈｅ ｏｆ"), (4, "ʃəʊ ɪʃ"), (5, "the of " + "🎉" * 50)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), langid.train(docs)).collect()}
    assert [got[i]["lang_pred"] == "und" for i, _ in rows] == [True, True, False, False, False]
    assert got[5]["lang_pred"] == "en" and got[5]["score"] == 1.0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    scores, bounds = rng.normal(size=(13, 3)).astype(np.float32) * 4, np.array([0, 4, 4, 9, 13])
    got = langid.viterbi(scores, bounds, 3.0)
    import itertools

    for a, b in zip(bounds[:-1], bounds[1:]):
        value = lambda p: sum(scores[a + t, s] for t, s in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:]))
        best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(value(tuple(got[a:b])) - best) < 1e-4


def test_language_without_learning(spark, docs):
    model = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs.select("doc_id", "text"), model, spans=False).collect()} == {"und"}


class PlainTree:
    """The suffix tree with dictionaries, for a list of token lists."""

    def __init__(self, texts, depth, min_count=5, min_bits=16.0):
        self.depth, grams = depth, [Counter() for _ in range(depth + 1)]
        for t in texts:
            for i in range(len(t)):
                for d in range(min(depth, i + 1) + 1):
                    grams[d][tuple((["<", *t])[i + 1 - d : i + 2])] += 1
        self.c = {k[0]: n for k, n in grams[0].items()}
        self.n, self.v = sum(self.c.values()), len(self.c)
        once, twice = (sum(n == k for n in self.c.values()) for k in (1, 2))
        self.taken = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.1
        self.own, self.back = {}, {}
        totals = {**{(w,): n for w, n in self.c.items()}, ("<",): len(texts)}
        for d in range(1, depth + 1):
            by = {}
            for k, n in grams[d].items():
                if n >= min_count:
                    by.setdefault(k[:-1], {})[k[-1]] = n
            new = {}
            for s, found in by.items():
                above = {x: self.p(s[1:], x) for x in found}
                share = {x: (n - lm.DISCOUNT) / totals[s] for x, n in found.items()}
                left = max(1 - sum(share.values()), 1e-12) / max(1 - sum(above.values()), 1e-12)
                if sum(n * math.log2(share[x] / above[x]) for x, n in found.items()) + (totals[s] - sum(found.values())) * math.log2(left) >= min_bits:
                    new[s] = share, left
            for s, (share, left) in new.items():
                self.own[s], self.back[s] = share, left
            totals |= grams[d]

    def p(self, s, x):
        """After the longest kept suffix of s."""
        if not s:
            return (self.c[x] - self.taken) / self.n if x in self.c else self.taken * self.v / self.n
        if s not in self.own:
            return self.p(s[1:], x)
        return self.own[s].get(x) or self.back[s] * self.p(s[1:], x)

    def score(self, t):
        full = ["<", *t]
        return sum(math.log10(self.p(tuple(full[max(0, i + 1 - self.depth) : i + 1]), x)) for i, x in enumerate(t))


@pytest.mark.parametrize(("depth", "hot"), [(0, (1 << 20, 1 << 21)), (1, (4, 0)), (2, (1 << 20, 1 << 21)), (2, (2, 5)), (3, (0, 0))])
def test_lm_against_plain_tree(spark, docs, depth, hot):
    rng = random.Random(8)
    more = [(2000 + i, " ".join(rng.choice(["A b c d", "b a", "x b c e", "q%d" % rng.randrange(300), "the of and"]) for _ in range(12)), None, None) for i in range(150)]
    df = docs.unionByName(spark.createDataFrame(more + more[:3], docs.schema)).select("doc_id", "text", F.col("lang").alias("score"))
    rows = df.collect()
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tree = PlainTree([words(r["text"]) + [None] for r in rows if not out(r["doc_id"])], depth)
    assert depth == 0 or (tree.own and any(len(s) == depth for s in tree.own))
    got = lm.score(df, depth=depth, hot=hot).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    got = {r["doc_id"]: r for r in got}
    for r in rows:
        t, g = words(r["text"]) + [None], got[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (out(r["doc_id"]), len(t), sum(w in tree.c for w in t), tree.n)
        assert math.isclose(g["base_score"], sum(math.log10((tree.c.get(w, 0) + 0.1) / (tree.n + 0.1 * (tree.v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(g["score"], tree.score(t), rel_tol=1e-9, abs_tol=1e-10 * len(t))  # terms of neighbours cancel out


def test_lm_tokens_sum_to_one(spark, docs):
    tree = PlainTree([words(r["text"]) + [None] for r in docs.collect()] * 2, 2)
    assert len(tree.own) > 20
    for s in [(), ("zz",), *tree.own]:
        assert abs(sum(tree.p(s, x) for x in [*tree.c, "zz"]) - 1) < 1e-9


def test_lm_contexts_help_held_out_texts(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tree, root = ({h: (s, b) for h, s, b in lm.score(df, depth=d).groupBy("held_out").agg(F.sum("score"), F.sum("base_score")).collect()} for d in (2, 0))
    for h in (True, False):
        assert tree[h][0] > root[h][0] and tree[h][0] > tree[h][1]


def test_lm_in_many_small_steps(spark, docs, monkeypatch):
    df = docs.select("doc_id", "text")
    want = {r["doc_id"]: r["score"] for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "BUCKET", 500)
    monkeypatch.setattr(lm, "SPLIT", 100)
    got = {r["doc_id"]: r["score"] for r in lm.score(df).collect()}
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in want)


def test_lm_with_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for learn in (F.lit(False), F.lit(None).cast("boolean")):
        r = lm.score(df, learn=learn).first()
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)
    assert lm.score(df.limit(0)).collect() == []
