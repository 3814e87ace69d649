"""Operators against brute-force versions, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import bilstm, decontaminate, fmindex, langid, licenses, media, mixing, near, private, shards, substrings, urls, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int"
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [f"w{i}" for i in range(40)] + ["é", "ß", "中"]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    sent = lambda k: [rng.choice(VOCAB) + rng.choice(["", ".", ","]) for _ in range(k)]
    shared = [sent(70) for _ in range(3)]
    texts = []
    for i in range(n):
        w = sent(rng.choice([0, 1, 4, 30, 60, 200]))
        if rng.random() < 0.5:
            at = rng.randint(0, len(w))
            w = w[:at] + rng.choice(shared)[: rng.choice([49, 50, 70])] + w[at:]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
        if i % 9 == 0 and i:
            texts.append(texts[rng.randint(0, i - 1)])
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None]), len(t), 7, 1) for i, t in enumerate(texts)]
    rows += [(None, "null id here", "en", "a", 3, 7, 1), (rows[3][0], *rows[3][1:]), (900, None, None, None, None, None, None), (901, "", "en", "é", 0, 7, 1), (902, " \n ", "en", "z", 3, 7, 1), (903, "long " + "ab " * 30000, "en", "z", 1, 7, 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def multiset(df):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


# ------------------------------------------------------------------ words
def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["Ab  cd\té", "", "cd Ab", None, "x" * 3000 + " Ab"]
    got = defaultdict(set)
    for i, _, data, offs in words.pieces(pa.array(texts), 40):
        w = words.Words(data, offs)
        for k in range(len(offs) - 1):
            own = PLAIN.findall(texts[i + k] or "")
            hs = w.hash[w.first[k] : w.first[k + 1]].tolist()
            assert len(own) == len(hs)
            for x, h in zip(own, hs, strict=True):
                got[x].add(h)
    assert all(len(v) == 1 for v in got.values()) and len({next(iter(v)) for v in got.values()}) == len(got)


# ------------------------------------------------------------------ 1
def test_mixing(spark, docs, rows):
    r, sources, blocks = mixing.plan(spark, docs)
    size = Counter()
    for row in rows:
        size[row[3]] += len(PLAIN.findall(row[1] or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while open_:  # share by weight, stop those above their ceiling, share anew
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    got = {x["source"]: x["target"] for x in sources.collect()}
    assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 for s in got)
    b = blocks.collect()
    taken, per_doc, per_shard = Counter(), Counter(), Counter()
    for x in b:
        taken[x["source"]] += x["taken"]
        per_doc[x["row_"]] += x["taken"]
        per_shard[x["shard"]] += x["taken"] > 0
        assert (x["shard"] is not None) == (x["taken"] > 0)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert all(per_doc[x["row_"]] <= 2 * x["size"] for x in r.collect())
    counts = [per_shard[s] for s in range(mixing.SHARDS)]
    assert max(counts) - min(counts) <= 1
    assert len({(x["row_"], x["pass"], x["block"]) for x in b}) == len(b)


def test_mixing_stage_and_empty(spark, docs, none):
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.stage(spark, none, "").count() == 0
    assert sum(len(PLAIN.findall(r["text"])) for r in out.collect()) == sum(x["taken"] for x in mixing.plan(spark, docs)[2].collect())


def test_mix_does_not_depend_on_the_layout(spark, rows, tmp_path):
    many = rows + [(None, "same words of a page", None, None, 1, 1, 1)] * 30 + [(7, "other words", "en", "b", k % 2, 1, 1) for k in range(20)]
    extra = spark.createDataFrame([(*r, "x", "y") for r in many], DOCS + ", taken_ string, parts_ string")
    seen = []
    for n in (1, 5):
        spark.createDataFrame(random.Random(n).sample(many, len(many)), DOCS).repartition(n).write.parquet(str(tmp_path / f"{n}/documents.parquet"))
        seen.append((multiset(mixing.query(spark, str(tmp_path / str(n)))), multiset(mixing.stage(spark, extra.repartition(n), ""))))
    assert seen[0] == seen[1]
    assert sum(seen[0][0].values()) == len(many)


def test_shard_quotas_follow_the_tree(spark, docs):
    _, _, blocks = mixing.plan(spark, docs)
    got = Counter((r["source"], r["shard"]) for r in blocks.where("taken > 0").collect())
    per = Counter()
    for (source, _), n in got.items():
        per[source] += n
    drawn = spark.createDataFrame(list(per.items()), "source string, blocks long")
    quotas = {(r["source"], r["shard"]): (r["first"], r["quota"]) for r in mixing.split_quotas(drawn).collect()}
    assert {k: q for k, (_, q) in quotas.items()} == dict(got)
    for source in per:  # runs of a source lie end to end
        at = 0
        for s in range(mixing.SHARDS):
            first, quota = quotas.get((source, s), (at, 0))
            assert first == at
            at += quota
        assert at == per[source]


def test_splitting_tree_draws(spark):
    """Seeds give different draws, near the mean; any number of sources and shards adds up."""
    drawn = spark.createDataFrame([("a", 1200), ("b", 1800), (None, 1000)], "source string, blocks long")
    ks = [next(r["quota"] for r in mixing.split_quotas(drawn, 2, seed).collect() if r["source"] == "a" and r["shard"] == 0) for seed in range(4)]
    assert len(set(ks)) > 1 and all(abs(k - 600) < 80 for k in ks)  # standard deviation 14.5
    for sources, shards in ((5, 7), (70, 16)):
        many = {f"s{k}": 1 + k * k % 23 for k in range(sources)}
        got = mixing.split_quotas(spark.createDataFrame(list(many.items()), "source string, blocks long"), shards).collect()
        by, per = Counter(), Counter()
        for r in got:
            by[r["source"]] += r["quota"]
            per[r["shard"]] += r["quota"]
        assert by == Counter(many) and max(per[s] for s in range(shards)) - min(per[s] for s in range(shards)) <= 1


def test_quota_draw_is_hypergeometric(spark):
    spark.range(3000).createOrReplaceTempView("draws")
    k = mixing._hypergeometric("t", "g", "d", "u")
    got = Counter(r["k"] for r in spark.sql(f"SELECT {k} AS k FROM (SELECT 30L AS t, 12L AS g, 10L AS d, (id + 0.5D) / 3000 AS u FROM draws)").collect())
    from math import comb

    for x in range(11):
        assert abs(got[x] / 3000 - comb(12, x) * comb(18, 10 - x) / comb(30, 10)) < 1e-3


# ------------------------------------------------------------------ 2
def brute_classes(rows):
    """Components of pairs of texts whose five-word shingles, in order, match 0.8 of all; by texts."""
    texts = {t: PLAIN.findall(t) for _, t, *_ in rows if t is not None}
    def sh(w):
        seen, out = Counter(), []
        for g in [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []:
            seen[g] += 1
            out.append((g, seen[g]))
        return out
    s = {t: sh(w) for t, w in texts.items()}
    root = {t: t for t in s}
    def find(t):
        while root[t] != t:
            t = root[t]
        return t
    names = sorted(s)
    for i, a in enumerate(names):
        for b in names[:i]:
            m = len(set(s[a]) & set(s[b]))
            if m and m / (len(s[a]) + len(s[b]) - m) >= 0.8:
                root[find(a)] = find(b)
    return {t: find(t) for t in s}


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [[f"v{rng.randint(0, 5000)}" for _ in range(rng.choice([60, 150, 400]))] for _ in range(12)]
    texts = []
    for w in base:
        texts.append(" ".join(w))
        for _ in range(4):  # a word in sixty or so differs
            c = list(w)
            for _ in range(max(1, len(c) // 70)):
                c[rng.randrange(len(c))] = f"n{rng.randint(0, 9999)}"
            texts.append("\n".join(c))
        texts.append(" ".join(reversed(w)))
    texts += [texts[0], texts[0], "", "", "two words", "two  words", "one"]
    rows = [(i, t, None, None, 0, 0, 0) for i, t in enumerate(texts)] + [(5, texts[5], None, None, 0, 0, 0), (1000, None, None, None, 0, 0, 0), (None, None, None, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    found = near.classes(spark, df).collect()
    assert len(found) == len(rows)
    of = {r["doc_id"]: r["class_id"] for r in found}
    brute = brute_classes(rows)
    least = {}
    for i, t, *_ in rows:
        if t is not None:
            least[brute[t]] = min(i, least.get(brute[t], i))
    assert {i: of[i] for i, t, *_ in rows if t is not None} == {i: least[brute[t]] for i, t, *_ in rows if t is not None}
    assert of[1000] == 1000 and of[None] is None
    kept = near.stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["text"] is not None) == sorted(set(least.values()))
    assert near.classes(spark, df.limit(0)).count() == 0


def test_alignment_is_ordered():
    a = np.arange(100, dtype=np.uint64)
    assert near.similarity(a, a) == 1.0 and near.similarity(a, a[::-1].copy()) < 0.1
    assert near.similarity(a, np.concatenate([a[:50], a[52:]])) == 98 / 100
    assert near.similarity(a[:0], a[:0]) == 0.0


def test_large_keys_go_another_round(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 100)
    rng = random.Random(5)
    w = [f"v{i}" for i in range(120)]
    texts = [" ".join(w)] + [" ".join(f"z{rng.randint(0, 99)}" if rng.random() < 0.02 else x for x in w) for _ in range(12)]
    df = spark.createDataFrame([(i, t, None, None, 0, 0, 0) for i, t in enumerate(texts)], DOCS)
    brute = brute_classes([(i, t) for i, t in enumerate(texts)])
    assert near.classes(spark, df).select("class_id").distinct().count() == len(set(brute.values()))


def test_similarity_at_the_threshold_with_the_insert_in_front():
    for k in range(1, 500):
        b = np.arange(5 * k, dtype=np.uint64)
        assert near.similarity(b[k:], b) == near.similarity(b, b[k:]) == 0.8


def same_classes(spark, texts):
    """The classes of texts, each with its own id, are those of brute force."""
    rows = list(enumerate(texts))
    of = {r["doc_id"]: r["class_id"] for r in near.classes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    brute, least = brute_classes(rows), {}
    for i, t in rows:
        least[brute[t]] = min(i, least.get(brute[t], i))
    return of == {i: least[brute[t]] for i, t in rows}


@pytest.mark.parametrize("block", [6000, 1 << 19])
def test_stars_and_chains_of_near_copies_stay_whole(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", block)
    rng = random.Random(8)
    o = [f"o{i}" for i in range(304)]
    star = [list(o)]
    for k in range(110):  # words 35 apart: each copy is similar to o, copies hardly to each other
        c = list(o)
        for i in range(5 + rng.randrange(15), 300, 50):
            c[i] = f"e{k}-{i}"
        star.append(c)
    chain = [[f"c{i}" for i in range(200)]]
    for k in range(110):  # the window moves, so that only those near in the chain are similar
        chain.append(chain[-1][18:] + [f"c{k}-{i}" for i in range(18)])
    texts = [" ".join(x) for x in star + chain]
    rng.shuffle(texts)
    assert same_classes(spark, texts)


def test_stage_columns_may_have_any_names(spark):
    w = " ".join(f"a{i}" for i in range(60))
    rows = [(1, w, "s", 0, 1, 2, 3), (2, w, "s", 0, 1, 2, 3), (3, w + " b", "s", 0, 1, 2, 3), (4, "other words here and there", "s", 0, 1, 2, 3), (None, None, "s", 0, 1, 2, 3), (1, w, "s", 0, 1, 2, 3), (1, w + " c", "s", 0, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_node_ string, d_ int, n_ int, m_ int, class_id int")
    got = near.stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, *r[2:]) for r in got.collect()) == [(0, "s", 0, 1, 2, 3), (1, "s", 0, 1, 2, 3), (4, "s", 0, 1, 2, 3)]


def test_a_key_of_many_unlike_texts(spark, monkeypatch):
    """A passage that many texts share: few of them are similar, and those are found whatever the size of blocks."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(120)]
    texts = []
    for k in range(400):
        own = [f"o{k}-{i}" for i in range(rng.choice([10, 25, 60, 100]))]
        texts.append(" ".join(passage + own))
        if k % 8 == 0:
            texts.append(" ".join(passage + own + ["end"]))
    got = []
    for block in (1 << 19, 3000):
        monkeypatch.setattr(near, "BLOCK_SHINGLES", block)
        got.append(same_classes(spark, texts))
    assert got == [True, True]


def test_short_similar_texts_are_candidates(spark):
    texts = []
    for k in range(12):  # a word more at an end: 4 and 5, 5 and 6, 8 and 10 shingles
        for n, m in ((8, 9), (9, 10), (12, 14)):
            w = [f"s{k}-{n}-{i}" for i in range(m)]
            texts += [" ".join(w[:n]), " ".join(w)]
    for k in range(60):  # 8 of 10 in common
        w = [f"t{k}-{i}" for i in range(13)]
        texts += [" ".join([*w, "x"]), " ".join([*w, "y"]), " ".join(["z", *w])]
    assert same_classes(spark, texts)


# ------------------------------------------------------------------ 3
def test_urls(spark):
    given = [
        ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/"), ("https://example.org/en/12?x=1", "example.org", "/en/12", "example.org/en/1"), ("x://myexample.org/es/1", "myexample.org", "/es/1", "org/"),
        ("https://b.com/fr/#t", "b.com", "/fr/", "com/fr/"), ("https://b.com/de", "b.com", "/de", None), ("https://b.com?x=/de/", "b.com", "", None), ("https://b.com/de/?a&b", "b.com", "/de/", "com/de/"), ("no scheme", "", "", None),
        (None, "", "", None), ("", "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("http://É.org/x\ny", "É.org", "/x\ny", "org/"), ("http://org/", "org", "/", "org/"), ("http://" + "a" * 50000 + ".org/", "a" * 50000 + ".org", "/", "org/"),
    ]
    df = spark.createDataFrame([(i, u, "h", 1) for i, (u, *_) in enumerate(given)], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r for r in urls.judge(spark, df).collect()}
    for i, (_, host, path, rule) in enumerate(given):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block")
        if rule:
            assert got[i]["verdict"] == {r: v for v, r in urls.RULES}[rule]
    assert urls.judge(spark, df.limit(0)).count() == 0


def test_rules_of_equal_length(spark):
    df = spark.createDataFrame([("a.b", "/x")], "h string, p string")
    for rules, want in (((("allow", "a.b/x"), ("block", "b/x")), "allow"), ((("allow", "a.b/"), ("block", "b/x"), ("allow", "b/x")), "allow"), ((("allow", "b/x"), ("block", "b/x")), "allow"), ((("block", "b/x"), ("allow", "b/x")), "block")):
        assert df.select(urls.fitting_rule(F.col("h"), F.col("p"), rules)[1].alias("v")).first()["v"] == want


def test_url_trees_learn_from_labels(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{'win-' * (bad := i % 2)}{rng.choice(['alpha', 'beta', 'gamma'])}.net/{'9' * rng.randint(3, 7) if bad else rng.choice(['about', 'news', 'shop'])}{'?a=1&b=2&c=3' * bad}", bad) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, block int").withColumn("host", urls.host(F.col("url"))).withColumn("path", urls.path(F.col("url")))
    held = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0
    model = urls.fit(spark, df.where(~held).select("url", "host", "path", "block"), rounds=4)
    out = urls.judge(spark, df.where(held).drop("host", "path"), rules=(), model=model).join(df.select("page_id", "block"), "page_id").collect()
    assert np.mean([(r["verdict"] == "block") == bool(r["block"]) for r in out]) > 0.95


# ------------------------------------------------------------------ 4
def test_rule_spans_are_those_of_the_patterns():
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(7)
    bits = ["a", "b.", "@", "x-y", ".", "1", "23", "255", "256", "4111 1111 1111 1111", " ", "+1", "(743)", "555-1234", "-", "é", "%", "4111-1111-1111-1111", "1.2.3.4"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        want = [(k, m.start(), m.end()) for k, p in pats.items() for m in re.finditer(p, t) if private.valid(k, m.group())]
        assert private.base_spans(t) == want, t
    assert private.base_spans(None) == private.base_spans("") == []
    assert private.base_spans("a" * 300000 + "@" + "1" * 100000) == []
    many = "one@two.three " * 20000
    assert len(private.training_windows(many)) <= private.PER_TEXT * 4 + 4 and len(private.base_spans(many)) == 20000
    net = bilstm.BiLstmCrf(private.TAGS)
    assert not any(b - a < 1 for _, a, b in private.added_spans(net, [many], [private.base_spans(many)])[0])


def test_network_gradient():
    net = bilstm.BiLstmCrf(private.TAGS, embed=3, hidden=2, dtype=np.float64)
    rng = np.random.default_rng(0)
    ids, gold = rng.integers(0, bilstm.CLASSES, (5, 3)), np.zeros((5, 3), np.int64)
    gold[1:3, 0] = [1, 2]
    _, g = net.loss(ids, gold)
    for k in net.p:
        at = tuple(rng.integers(0, n) for n in net.p[k].shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-5
        hi = net.loss(ids, gold)[0]
        net.p[k][at] = keep - 1e-5
        lo = net.loss(ids, gold)[0]
        net.p[k][at] = keep
        assert abs((hi - lo) / 2e-5 - g[k][at]) < 1e-4 * max(1, abs(g[k][at]))


def test_network_adds_forms_that_rules_miss(spark):
    rng = random.Random(1)
    number = lambda: "".join(str(rng.randint(0, 9)) for _ in range(7))
    texts = [f"{rng.choice(VOCAB)} slovo +1 ({(n := number())[:3]}) 555-{n[3:]} {rng.choice(VOCAB)} and 12 words" for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    net = private.learn(spark, df)
    held = [f"prosim volajte ({(n := number())[:3]}) 555-{n[3:]} dnes" for _ in range(50)]
    more = private.added_spans(net, held, [private.base_spans(t) for t in held])
    assert np.mean([[t[a:b] for _, a, b in m] == [t[15:29]] for t, m in zip(held, more, strict=True)]) > 0.8
    docs = spark.createDataFrame([(0, texts[0]), (1, None), (2, ""), (None, texts[0])], "doc_id long, text string")
    out = private.find(spark, docs, net).collect()
    assert [r["n_phone"] for r in sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"]))] == [1, 0, 0, 1]
    assert out[0]["spans"].startswith("phone:") and private.find(spark, docs.limit(0), None).count() == 0
    assert private.learn(spark, df.limit(0)) is None


def test_spans_longer_than_windows_are_whole():
    """Tags are reconciled over the text: a net that tags all digits inside finds a run of any length as one span."""

    class Digits:
        def decode(self, ids):
            d = (ids < 10) | (ids == bilstm.OWN.index(" "))
            return np.where(d, np.where(np.vstack([np.zeros_like(d[:1]), d[:-1]]), 8, 7), 0)

    for lead in (0, 5, 40, 90, 200):
        for size in (1, 30, 95, 200, 700):
            t = "x" * lead + "7" * size + "y" * 60
            tags = private._tags(Digits(), [t])[0]
            assert (tags[:lead] == 0).all() and (tags[lead : lead + size] > 6).all() and (tags[lead + size :] == 0).all()
    assert private._pieces("card", "4111111111111111 4111111111111111", 0, 33) == [(0, 16), (17, 33)]


# ------------------------------------------------------------------ 5
def test_patience_and_licenses(spark):
    assert licenses.patience(list("abcxdef"), list("abcydef")) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    assert licenses.patience([], list("a")) == [] == licenses.patience(list("aa"), list("b"))
    mit = licenses.TEMPLATES["MIT-full"]
    cut = mit.replace("without restriction", "with no").replace("publish, ", "")
    rows = [(0, f"word {mit} more"), (1, cut), (2, "Licensed under CC BY-NC 4.0. x"), (3, "the license of the software"), (4, None), (5, ""), (6, "x " * 20000 + licenses.TEMPLATES["GPL-3.0"] + " y" * 20000), (6, mit), (None, "Released under the MIT License.")]
    got = [(r["doc_id"], r["license"], r["licenses"]) for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((d is None, d or 0, x or "") for d, x, _ in got) == [(False, 0, "MIT-full"), (False, 1, "MIT-full"), (False, 2, "CC-BY-NC-4.0"), (False, 3, ""), (False, 4, ""), (False, 5, ""), (False, 6, "GPL-3.0"), (False, 6, "MIT-full"), (True, 0, "MIT")]
    assert [x for d, _, x in got if d == 6 and x.startswith("GPL")] == ["GPL-3.0:20000:20012"]


def common(a, b):
    """Words of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_licenses_against_every_stretch():
    rng = np.random.default_rng(7)
    for _ in range(300):
        t = [f"t{i}" for i in rng.permutation(40)[: rng.integers(5, 16)]]
        body = [w for w in t if rng.random() > rng.choice([0.0, 0.1, 0.25])]
        for _ in range(rng.integers(0, 3 * len(t))):  # other words in between
            body.insert(rng.integers(0, len(body) + 1), f"x{rng.integers(50)}")
        noise = lambda: [f"x{k}" if rng.random() < 0.9 else rng.choice(t) for k in rng.integers(0, 50, rng.integers(0, 40))]  # noqa: B023, E731
        text = [*noise(), *body, *noise()]
        scanner = licenses.Scanner({"T": " ".join(t)})
        data = np.frombuffer(" ".join(text).encode(), np.uint8)
        h = words.Words(data, np.array([0, len(data)]), words.FOLDED).hash
        found = scanner.scan(h, scanner.marked(h))
        need, longest = -(-8 * len(t) // 10), 3 * len(t)
        assert all(y - x <= longest and common(text[x:y], t) >= need for _, _, x, y in found)
        assert bool(found) == any(common(text[x : x + longest], t) >= need for x in range(len(text)))


def test_licenses_of_one_family_are_told_apart(spark):
    rows = [(n, f"some words before {text} and some after it") for n, text in licenses.TEMPLATES.items()]
    got = licenses.scan(spark, spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r["doc_id"] for r in got if r["license"] != r["doc_id"] and not r["licenses"].startswith(r["doc_id"])] == []


def test_repeated_licenses_are_all_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in licenses.TEMPLATES:
        k = len(scanner.words[name])
        for times, gap in ((2, 0), (2, 5), (2, 10), (3, 20), (2, 100), (9, 3)):
            text = " ".join(["x"] * 30 + ([licenses.TEMPLATES[name]] + ["y"] * gap) * times + ["z"] * 30)
            data = np.frombuffer(text.encode(), np.uint8)
            h = words.Words(data, np.array([0, len(data)]), words.FOLDED).hash
            got = sorted(scanner.scan(h, scanner.marked(h)), key=lambda f: f[2])
            assert got == [(name, 1.0, 30 + i * (k + gap), 30 + i * (k + gap) + k) for i in range(times)], (name, times, gap)


# ------------------------------------------------------------------ 6
def test_language(spark, docs, tmp_path):
    rng = random.Random(6)
    sounds = {"en": "th he er ing", "de": "ch ung ei sch", "fr": "eau ou que é", "es": "ción os ña ll"}
    made = [(i, " ".join("".join(rng.choice(sounds[l].split()) for _ in range(3)) for _ in range(30)), l if i % 7 else None) for i, l in enumerate(rng.choice(list(sounds)) for _ in range(400))]
    truth = {i: next(l for l in sounds if any(s in t for s in [sounds[l].split()[-1], sounds[l].split()[0]])) for i, t, _ in made}
    made += [(500, None, "en"), (501, "12 34 !", "en"), (502, "", "fr"), (None, "the thing", "en")]
    spark.createDataFrame(made, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in langid.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(made) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in truth if got[i]["held_out"]]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "")
    assert kept.columns == ["doc_id", "text", "lang", "score"] and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["score"] >= langid.MIN_SCORE} >= {i for i in truth if got[i]["score"] > 0.9}
    assert langid.stage(spark, docs.limit(0), "").count() == 0


def test_stage_uses_the_prediction(spark):
    rng = random.Random(16)
    sounds = {"en": "the ing and of", "de": "ich ung ei sch", "fr": "eau ou que é", "xx": "zka vky pro ný"}
    text = lambda l, n=40: " ".join("".join(rng.choice(sounds[l].split()) for _ in range(3)) for _ in range(n))
    rows = [(i, text(l), l, "a", 1) for i, l in enumerate(list(sounds) * 80)]
    rows += [(1000, text("de"), "en", "a", 1), (1001, text("xx"), None, "a", 1), (1002, "Ж щ ъ ю " * 30 + "qq wx 8", "en", "a", 1), (1003, "4 5", "en", "a", 1), (1004, None, "en", "a", 1), (1005, "", None, "a", 1), (None, text("fr"), "fr", "a", 1), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lid_text_ int")
    kept = langid.stage(spark, df, "")
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["lang"]) for r in kept.collect()]
    assert sorted(g for g in got if g[0] is not None and g[0] < 1000) == sorted((r[0], r[2]) for r in rows if r[0] is not None and r[0] < 1000)
    assert (1000, "de") in got and (1001, "xx") in got and (None, "fr") in got and not {1003, 1004, 1005} & {g[0] for g in got}
    pred = langid.predict(spark, df, None)
    assert pred.columns == ["doc_id", "lang", "score_", "lid_text_", "lang_pred", "score"]


def test_all_languages_are_learned(spark):
    rng = random.Random(17)
    rows = []
    for k in range(90):  # each writes with three letters of its own
        own = [chr(0x4E00 + 3 * k + j) for j in range(3)]
        rows += [(" ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(12)), f"l{k}") for _ in range(4)]
    model = langid.learn(spark, spark.createDataFrame(rows, "text string, lang string"))
    assert sum(map(len, model.languages.values())) == 90
    assert np.mean([model.predict(langid.features(t))[0] == l for t, l in rows[::5]]) > 0.9


def test_language_without_labels(spark):
    assert langid.learn(spark, spark.createDataFrame([], "text string, lang string")) is None
    assert langid.predict(spark, spark.createDataFrame([(1, "abc")], "doc_id long, text string"), None).first()["lang_pred"] == "und"


# ------------------------------------------------------------------ 7
def brute_windows(rows, size=50):
    low = {}
    big = 2**63 - 1
    for i, t, *_ in rows:
        w = PLAIN.findall(t or "")
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            low[g] = min(low.get(g, big), big if i is None else i)
    out = Counter()
    for i, t, *_ in rows:
        w = PLAIN.findall(t or "")
        gone = set()
        for k in range(len(w) - size + 1):
            if low[tuple(w[k : k + size])] < (big if i is None else i):
                gone.update(range(k, k + size))
        out[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [4000, 0])
def test_substrings(spark, rows, none, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 400)
    page = " ".join(f"b{i}" for i in range(80))
    many = rows + [(None, page, None, None, 1, 1, 1)] * 25 + [(None, f"{page} {k}", None, None, 1, 1, 1) for k in range(5)] + [(950, page + " end", None, None, 1, 1, 1)] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in many], DOCS + ", t string, gone int").repartition(3)
    assert multiset(substrings.dedup(spark, df).drop("runs")) == brute_windows(many)
    assert substrings.dedup(spark, none).count() == 0


def test_fm_index_against_scanning():
    rng = np.random.default_rng(4)
    for _ in range(20):
        pieces = [rng.integers(1, 4, rng.integers(50, 70)) for _ in range(4)]
        pieces[2][:50] = pieces[0][:50]
        owner = rng.integers(0, 3, 4)
        got = substrings.repeated_windows(pieces, owner)
        for p, o, ranges in zip(pieces, owner, got, strict=True):
            want = {k for k in range(len(p) - 49) if any(q < o and any((p[k : k + 50] == x[j : j + 50]).all() for j in range(len(x) - 49)) for x, q in zip(pieces, owner, strict=True))}
            assert {k for a, b in ranges for k in range(a, b + 1)} == want
    # the length of every match against brute force, for patterns of few words, which share much
    for sigma in (1, 2, 3, 5):
        parts = [rng.integers(1, sigma + 1, int(k)) for k in rng.integers(1, 25, 30)]
        owner = np.sort(rng.integers(0, 12, 30)) if sigma == 2 else rng.integers(0, 12, 30)
        length = np.array([len(x) for x in parts])
        start = np.cumsum(length + 1) - length - 1
        codes = np.concatenate([np.append(x, 0) for x in parts])
        index = fmindex.FMIndex(codes, np.repeat(owner, length + 1), int(length.max()) + 2)
        for least in (1, 6):
            got = index.matching_statistics(codes, start, start + length, owner, least)
            for x, o, s in zip(parts, owner, start, strict=True):
                before = {tuple(y[i:j]) for y, p in zip(parts, owner, strict=True) if p < o for i in range(len(y)) for j in range(i + 1, len(y) + 1)}
                want = [max((j - i for j in range(i + 1, len(x) + 1) if tuple(x[i:j]) in before), default=0) for i in range(len(x))]
                assert [m if m >= least else 0 for m in got[s : s + len(x)].tolist()] == [m if m >= least else 0 for m in want]
                assert all(g in (0, m) for g, m in zip(got[s : s + len(x)].tolist(), want, strict=True))
    wm = fmindex.WaveletMatrix(s := rng.integers(0, 9, 300), 9)
    assert all(wm.rank(np.array([c]), np.array([i]))[0] == (s[:i] == c).sum() for c in range(9) for i in (0, 1, 64, 128, 299, 300))


# ------------------------------------------------------------------ 8
def test_shards(spark, docs, rows, none):
    got = shards.shard(spark, docs).collect()
    assert len(got) == len(rows)
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert shards.shard(spark, none).count() == 0 and shards.stage(spark, docs, "").columns[-1] == "shard_"


def test_keys_move_only_to_the_new_shard_and_evenly(spark):
    key = F.col("id").cast("string")
    for n in (16, 17, 20):
        moved = spark.range(4000).select(shards.draw_shard(key, shards.topology(n)).alias("a"), shards.draw_shard(key, shards.topology(n + 1)).alias("b")).collect()
        assert all(r["b"] in (r["a"], n) for r in moved) and any(r["b"] == n for r in moved)
        assert min(Counter(r["a"] for r in moved).values()) > 4000 / n * 0.6
    tree = shards.topology(16)
    heavy = {g: {r: [(s, 3.0 if s == 5 else w) for s, w in x] for r, x in racks.items()} for g, racks in tree.items()}
    both = spark.range(4000).select(shards.draw_shard(key, tree).alias("a"), shards.draw_shard(key, heavy).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["b"] < 8 for r in both)  # into the region whose weight grew, no other
    assert all(r["a"] == r["b"] or r["b"] in (4, 5, 6, 7) for r in both if r["a"] < 8)  # and within it into the rack whose weight grew
    assert all(r["a"] == r["b"] or r["b"] == 5 for r in both if r["a"] in (4, 5, 6, 7))


# ------------------------------------------------------------------ 9
def brute_hits(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = [(str(i), fold(t)) for i, t in items if i is not None]
    windows = [(i, tuple(w[k : k + min(8, len(w))])) for i, w in windows if w for k in range(max(1, len(w) - 7))]
    out = Counter()
    for i, t, *_ in rows:
        w, hit, found = fold(t), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(item)
        out[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)] += 1
    return out


@pytest.mark.parametrize("bits,broadcast", [(1 << 24, 1 << 25), (64, 0)])
def test_decontamination(spark, docs, rows, none, bits, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)  # a full filter spares nothing
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    short = rows[:40] + rows[-6:-1]
    texts = [t for _, t, *_ in short if t and len(t) > 100]
    items = [(1, texts[0][3:90]), (2, texts[1][10:60].upper()), (10, "W1"), (11, texts[0][20:95]), (12, ""), (13, None), (None, texts[2]), (14, "..."), (2, "w3 w4"), (15, "É ß"), (16, texts[0][3:90])]
    df = spark.createDataFrame(short, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(spark, df, bench).drop("runs")
    assert multiset(got) == brute_hits(short, items)
    assert multiset(decontaminate.report(spark, df, bench.limit(0)).drop("runs")) == brute_hits(short, [])
    assert decontaminate.report(spark, none, bench).count() == 0


def test_documents_with_one_item_each_are_removed(spark):
    rng = random.Random(12)
    sent = lambda p, n: " ".join(f"{p}{rng.randint(0, 10**6)}" for _ in range(n))
    items = [(k, sent("q", rng.choice([5, 8, 20, 40]))) for k in range(12)] + [(50, "and")]
    docs, dirty = [], set()
    for k in range(60):
        text = sent("d", rng.choice([3, 50, 300]))
        if k % 3 == 0:  # one window of one item
            w = items[k % 12][1].split()
            at = rng.randint(0, max(0, len(w) - 8))
            text = f"{text} {' '.join(w[at : at + 8])} and {sent('e', 9)}"
            dirty.add(k)
        elif k % 3 == 1:  # seven of its words, or a word that is an item
            text = f"{text} {' '.join(items[3][1].split()[:7]) if len(items[3][1].split()) >= 8 else ''} and more"
        docs.append((k, text, "x", 1, k))
    docs += [(100, None, None, None, None), (101, "", "x", 1, 1), (0, docs[0][1], "x", 1, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, digest string, n_words int, w int").repartition(3)
    kept = decontaminate.clean(spark, df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    assert multiset(kept) == Counter(d for d in docs if d[0] not in dirty)


# ------------------------------------------------------------------ 10
def slow_cuts(data):
    """Ends of chunks by the gear hash one byte at a time: its 32 bits hold the last 32 bytes."""
    out, start, h = [], 0, 0
    for i, c in enumerate(data):
        h = ((h << 1) + int(media._GEAR[c])) & 0xFFFFFFFF
        n = i + 1 - start
        if len(data) - start <= media.LEAST:
            break
        if n >= media.LEAST and (h >> 16) & int(media.MASK) == 0 or n == media.MOST:
            out.append(i + 1)
            start = i + 1
    return out + ([len(data)] if start < len(data) else [])


def brute_media(rows):
    """All columns of the query, by text: owners are the least (key, place) of a chunk's name, keys being digests of chunk lists."""
    payloads = {}
    for _, t, *_ in rows:
        raw = (t or "").encode()
        data = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        ends = slow_cuts(data)
        chunks = [data[a:e] for a, e in zip([0, *ends], ends)]
        names = [hashlib.sha256(c).digest() for c in chunks]
        payloads[media.key_of(len(raw), names)] = (raw, data, chunks, names)
    owner = {}
    for key in sorted(payloads):
        for k, d in enumerate(payloads[key][3]):
            owner.setdefault(d, (key, k))
    out = {}
    for key, (raw, data, chunks, names) in payloads.items():
        away = {k for k, d in enumerate(names) if owner[d] != (key, k)}
        form = media.stored(len(raw), list(zip(names, chunks)), away)
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        x, p = np.frombuffer(data, np.uint8).astype(float), counts[counts > 0] / len(data)
        feature = f"chunks={len(chunks)};mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f}"
        out[raw] = (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(form), hashlib.sha256(form).hexdigest(), feature)
    return Counter((i, *out[(t or "").encode()]) for i, t, *_ in rows)


def test_media(spark, rows, tmp_path, none):
    rng = random.Random(1)
    block = "".join(rng.choice("abcdefgh ") for _ in range(30000))
    many = rows + [(2000, block, None, None, 0, 0, 0), (2001, "x" + block, None, None, 0, 0, 0), (2002, block + "y", None, None, 0, 0, 0), (2003, block[:200] + "😀", None, None, 0, 0, 0), (2004, block, None, None, 0, 0, 0)]
    many += [(None, block[5000:] + str(k % 3), None, None, 0, 0, 0) for k in range(12)] + [(None, None, None, None, 0, 0, 0)] * 3
    spark.createDataFrame(many, DOCS + "").withColumn("t", F.lit(1)).withColumn("key", F.lit("k")).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = media.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert multiset(got) == brute_media(many)
    scratch = media.Scratch(spark, "test")
    made, store, refs, loans = media.store(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), scratch)
    assert made.count() == len(many) and store.count() == store.select("key").distinct().count()
    held, whole = store.agg(F.sum(F.length("media"))).first()[0], sum({r["media_sha256"]: r["payload_bytes"] for r in got.collect()}.values())
    assert held < whole - 40000  # shifted copies share their chunks
    made, store, refs, loans = media.store(spark, none, scratch)
    assert made.count() == store.count() == media.read_back(store, refs, loans, scratch).count() == 0
    data, n = media.payload(block)
    form = media.stored(n, media.chunked(data), {1})
    lent = {1: media.chunked(data)[1][1]}
    assert media.opened(form, lent) == (n, data)
    for bad in (form[:-5] + b"?" + form[-4:], form[:-1]):
        with pytest.raises(ValueError):
            media.opened(bad, lent)
    with pytest.raises(ValueError):
        media.opened(form)
