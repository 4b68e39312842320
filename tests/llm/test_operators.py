"""Each operator against brute force on small tables, and on odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.llm import byte_bpe, chat, line_dedup, mixing, ngram_join, quality, queries, sharding, topk, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i * i % 977}" for i in range(20_000))
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (5, "ONE\ntwo", "en", None, 7),
    (None, "one two three four five six", "en", "a", 27), (6, "one two three four five six", "de", "b", 27), (7, LONG, "en", "b", len(LONG)), (8, LONG + " more", "en", "b", len(LONG) + 5), (9, "é\u2028ß 漢字 \U0001f600", "en", "c", 9),
    (4, "other text of the same id", "en", "a", 25),
]


def clashing(df):
    """With columns whose names the operators use inside."""
    for c in ("d", "h", "c", "n", "key", "size", "copy", "bytes", "token", "score", "shard", "rank", "row", "runs", "label", "bucket", "target", "g", "v", "q", "w", "t", "k"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(spark.createDataFrame(ODD, DOCS))


@pytest.fixture(scope="module")
def none(spark):
    return clashing(spark.createDataFrame([], DOCS))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda frame: sorted(map(repr, frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).values.tolist()))
    assert key(got) == key(want)


# 1 n-gram join


def brute_components(rows):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return sorted((d, len(sets[i]), min(least[root(i)])) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups=12, alone=60):
    """Copies with a few edits, shared passages, and texts made of little else."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = []
    for _ in range(groups):
        base = text(rng.choice([6, 12, 40, 90, 200]))
        for _ in range(rng.choice([2, 3, 9])):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(t)
    out += [text(rng.choice([1, 3, 5, 8, 60, 150])) for _ in range(alone)]
    out += [passage + text(rng.choice([2, 4, 6, 9, 100])) for _ in range(25)]
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed, broadcast", [(1, 1_000_000), (2, 0)])
def test_ngram_join(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    rows = near_copies(seed)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.d, r.n_shingles, r.component) for r in got) == brute_components(rows)


def test_ngram_join_without_its_first_round(spark, monkeypatch):
    """The prefixes alone must find every link."""
    monkeypatch.setattr(ngram_join, "_starred", lambda classes: classes.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0))
    rows = near_copies(3, groups=8, alone=30)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.d, r.n_shingles, r.component) for r in got) == brute_components(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_repeated_rows(spark, monkeypatch, seed):
    """Rows that stand several times don't close a document that links at 0.80 to 0.85."""
    monkeypatch.setattr(ngram_join, "_starred", lambda classes: classes.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0))
    rng, rows = random.Random(seed), []
    for i in range(12):
        n = rng.choice([13, 104, 204])
        base = [f"r{i}x{k}" for k in range(n)]
        own = (n - 4) // 9  # of n - 4 shingles of either: 8 of 10 shared, or a little more
        near = base[own:] + [f"s{i}x{k}" for k in range(own)]
        rows += [(2 * i, " ".join(base))] * 6 + [(2 * i + 1, " ".join(near))] * 6
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.d, r.n_shingles, r.component) for r in got) == brute_components(rows)
    assert all(r.component % 2 == 0 for r in got)


def test_ngram_join_odd(odd, none):
    low = -(1 << 63)
    got = ngram_join.join(odd).collect()
    assert sorted((r.d, r.n_shingles, r.component) for r in got) == brute_components([(low if d is None else d, t) for d, t, *_ in ODD])
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((d is None, d or 0, t or "") for d, t in [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (None, "one two three four five six"), (7, LONG), (9, ODD[10][1]), (4, "other text of the same id")])
    assert ngram_join.join(none).count() == 0 and ngram_join.one_of_each(none).count() == 0


# 2 toxicity


def test_toxicity_held_out_and_misspelt():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randrange(3, 9))) for _ in range(600)]
    bad = ["grumbolt", "snivelrot", "clodpated", "vermintongue"]

    def text(toxic):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 400))]
        for _ in range(toxic * max(2, len(t) // 60)):
            t[rng.randrange(len(t))] = rng.choice(bad)
        return " ".join(t)

    y = [int(rng.random() < 0.3) for _ in range(500)]
    score = toxicity.train([text(x) for x in y], y).scorer()
    test = [int(rng.random() < 0.3) for _ in range(300)]
    right = sum((score(text(x)) >= 0.5) == bool(x) for x in test)
    assert right >= 0.95 * len(test)
    plain = " ".join(vocabulary[:60])
    assert score(plain + " Grumbollt snivellrot") > score(plain) and score(plain + " grumbolts clodpateds snivelrots") >= 0.5
    assert toxicity.train(["a"], [1]).scorer()("") > 0.5 and toxicity.train([], []).scorer()("x") == 0.5


def plain_toxicity(model, text):
    worst = -float("inf")
    for passage in toxicity.passages_of(text):
        rows = [row for word in passage for row in toxicity.subwords(word)]
        worst = max(worst, math.fsum(model.pull[rows].tolist()) / max(len(rows), toxicity.LEAST))
    return 1 / (1 + math.exp(-(worst + model.bias)))


def test_toxicity_scores_of_batches(monkeypatch):
    rng = random.Random(8)
    model = toxicity.Model(np.random.default_rng(8).standard_normal(toxicity.BUCKETS).astype(np.float32) * 9, -0.5)
    texts = ["", " \n", "a", "ab", "abc", "abcd", "<a>", "a.b", "...", "日", "\U0001f600", "é\U0001f600", "x" * 70_000, "日" * 40_000, LONG]
    texts += ["".join(rng.choice("abXY 0.,'|é\u0130жЯ日\U0001f600\t\n\u0085#$") for _ in range(rng.choice([5, 50, 2_000]))) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(30)}" for _ in range(n)) for n in range(125)]
    got = model.scores(texts)
    assert np.abs(got - [plain_toxicity(model, t) for t in texts]).max() < 1e-6
    assert got.tolist() == [model.scorer()(t) for t in texts] and len(model.scores([])) == 0
    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    monkeypatch.setattr(toxicity, "RUN", toxicity.PASSAGE)
    assert model.scores(texts[::-1][60:]).tolist() == got[::-1][60:].tolist()


def test_toxicity_cost_of_new_words():
    """Texts of words never seen before cost a small multiple of their splitting, not a Python step for each of their n-grams."""
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdefghijklmnoprstuvz", k=9)) for _ in range(60_000))
    model = toxicity.Model(np.ones(toxicity.BUCKETS, np.float32), 0.0)

    def seconds(run):
        taken = []
        for _ in range(3):
            begin = time.process_time()
            run(text)
            taken.append(time.process_time() - begin)
        return min(taken)

    assert seconds(lambda t: model.scorer()(t)) < 20 * seconds(toxicity._word.findall)


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) if r.doc_id is not None else r.held_out is None for r in got)
    assert toxicity.clean(odd, model).columns == odd.columns
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0 and toxicity.clean(none, model).count() == 0


# 3 URL filters


def test_urls_odd(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.NET/en/x?y#z", "https://example.net/EN/", "http://example.netx/en/", "x://net", "x://net/", "x://a.net/ads/", "x://example.com/de/1", "x://b.example.com/d/tracker", "x://q.org/fr/", "x://org/fr", "x://h?://net/", "x://ads.example.org", "x://loads.example.org/", "x://u@net:80/\n/en"]
    rows = clashing(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(4, urls[4], "h"), (None, "x://net/", "h")], "page_id long, url string, html string"))

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut : min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        import re

        words_ = re.split("[^a-z0-9]+", (host + path).lower())
        return host, path, None, "block" if set(words_) & set(url_filter.AD_WORDS) else "allow"

    got = url_filter.judge(rows).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute("x://net/" if r.page_id is None else urls[r.page_id])
    assert url_filter.judge(rows.limit(0)).count() == 0


def test_url_rules(spark):
    """Every rule of a list is found through the index, letters beyond A-Z are not folded, and exceptions win."""
    lines = ["||ads.example^", "*/banner/*", "|track.", "pixel.gif|", "@@||ads.example/ok^", "@@*/banner/own/", "*tele*metry*", "shop^"]
    urls = ["x://ads.example/1", "x://a.ads.example", "x://ads.example/ok/", "x://ads.examplex/", "x://a.b/banner/1", "x://a.b/xbanner/1", "x://a.b/banner/own/", "x://track.a/", "x://a.track.b/", "x://a.b/pixel.gif", "x://a.b/pixel.gif/", "x://a.b/telemetry", "x://a.b/myteleXmetry2", "x://shop/", "x://myshop", "x://shopx/", "x://a.b/BANNER/2", "x://a.b/banİner/", "x://x.y/adsİ/1"]
    rules = [url_filter.parsed_rule(x) for x in lines] + [url_filter.word_rule("ads")]
    import re

    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for i, u in enumerate(urls):
        target = u.split("://", 1)[1]
        fits = [r for r in rules if re.search(r.pattern, target, re.A)]
        assert got[i].verdict == (max(fits, key=lambda r: r.rank).verdict if fits else "allow"), u
    assert [got[i].verdict for i in (0, 1, 2, 3, 5, 6, 8, 10, 14, 15, 18)] == ["block", "block", "allow", "block", "allow", "allow", "allow", "allow", "block", "allow", "block"]


# 4 sharding


@pytest.mark.parametrize("limit, step", [(300, 12), (20_000, 12), (60, 2), (1 << 40, 12)])
def test_shards(docs, limit, step):
    rows = docs.limit(200).select("doc_id", F.substring("text", 1, 200).alias("text")) if limit < 1000 else docs
    got = sharding.shards(rows, limit, step).collect()
    assert len(got) == rows.count()
    by, total = defaultdict(list), Counter()
    for r in got:
        by[r.shard].append(r.bytes)
        for k in range(len(r.shard)):
            total[r.shard[:k]] += r.bytes
        assert len(r.shard) == r.depth
    assert all(sum(b) <= limit or len(b) == 1 for b in by.values())
    assert all(n > limit for n in total.values()), "only oversized buckets split"
    assert all(not a.startswith(b) for a in by for b in by if a != b)


def test_shards_odd(spark, odd, none, tmp_path):
    got = sharding.shards(odd.unionByName(odd), 100).collect()
    assert len(got) == 2 * len(ODD) and sum(r.bytes for r in got) == 2 * sum(len((t or "").encode()) for _, t, *_ in ODD)
    assert sharding.shards(none).count() == 0
    sharding.write_shards(spark.createDataFrame(ODD, DOCS), str(tmp_path / "s"), 100)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


def test_write_shards_of_equal_rows(spark, none, tmp_path):
    """Each copy goes to the shard of its number, so folders keep the limit; an empty table writes no row."""
    rows = [(1, "x" * 98, f"s{i}") for i in range(50)] + [(i, "y" * 60, "t") for i in range(2, 40)]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string, copy string"), str(tmp_path / "s"), 300)
    got = spark.read.option("basePath", str(tmp_path / "s")).schema("doc_id long, text string, copy string, shard string").parquet(str(tmp_path / "s")).collect()
    size, by = Counter(), Counter(r.shard for r in got)
    for r in got:
        size[r.shard] += len(r.text)
    assert sorted((r.doc_id, r.text, r.copy) for r in got) == sorted(rows) and all(size[k] <= 300 or by[k] == 1 for k in by)
    sharding.write_shards(none.drop("shard"), str(tmp_path / "none"), 300)


# 5 top-k


def brute_topk(rows, k):
    """(query_id, rank, vec_id, score) lists with exact integers, row by row."""
    ints = [(i, [math.floor(256 * x) if abs(x) < 2.0**1000 else 256 * int(x) for x in v]) for i, v in rows]
    out = []
    for n, (i, q) in enumerate(ints):
        if i % 4 == 0:
            scores = [(max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for m, (j, v) in enumerate(ints) if m != n and len(v) == len(q)]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 2.0**17, 2.0**33, 1e300])
def test_topk_odd(spark, size):
    """Also with components whose products double precision does not hold, in some vectors or in all."""
    rng = random.Random(2)
    good = [(i, [rng.choice([-0.5, 0.25, 0.126, 0.9]) * rng.choice([1, size + rng.random()]) for _ in range(3)]) for i in range(60)]
    good += [(200 + i, [rng.uniform(-1, 1) * size for _ in range(64)]) for i in range(60)] + [(104, [1.0, 2.0]), (8, [0.3, 0.3, 0.3]), (8, [0.3, 0.3, 0.3]), (8, [9.0, 9.0, 9.0])]
    bad = [(100, None), (101, [1.0, None, 0.0]), (102, [float("nan"), 1.0, 0.0]), (103, [float("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (105, [])]
    rows = clashing(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>"))
    for shard, block in ((16, 4), (4096, 512)):
        got = sorted(tuple(r) for r in topk.search(rows, F.col("vec_id") % 4 == 0, 5, shard, block).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute_topk(good, 5)
    assert topk.search(rows.limit(0), F.col("vec_id") % 4 == 0).count() == 0


# 6 chat formatting


@pytest.mark.parametrize("budget, history, segment", [(1024, 256, 1024), (60, 25, 1024), (60, 25, 7), (1, 0, 5)])
def test_chat(spark, budget, history, segment):
    rng = random.Random(4)
    pieces = ["</s>", "[INST]", "\\", "<|turn|>", "<|te", "xt|>", "<|end|>", "word ", "\n", "é ", "<\\s>", "\\\\"]
    rows = [(c, t, "system" if t == 0 and (c or 0) % 2 else rng.choice(["user", "assistant", None, "a<|text|>b"]), rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))])) for c in [0, 1, 2, 3, None] for t in range(rng.randrange(1, 30))]
    df = clashing(spark.createDataFrame(rows + [rows[0]], "conv_id long, turn long, role string, text string"))
    wins = chat.windows(df, budget, history, segment)
    got = {r.conv_id: r for r in chat.digests(wins).collect()}
    by = defaultdict(list)
    for c, t, role, text in [*rows, rows[0]]:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in wins.collect():
        new = list(chat.read_back(w.text, w.new_at))
        head = next(chat.read_back(w.text), None)
        alone = sum(chat.token_count(*x) for x in {*new[:1], *([head] if w.new_at and head and head[0] == "system" else [])})
        assert w.tokens <= budget or len(new) == 1 and w.tokens == alone, "history gives way to a long turn"
        if w.window and (c := w.conv_id) is not None and c % 2:
            assert next(chat.read_back(w.text))[0] == "system"
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


@pytest.mark.parametrize("step, system", [(1, None), (1, 0), (1, 9), (5, 0)])
def test_chat_history_crosses_segments(spark, step, system):
    """A later segment's first window begins with the last turns before it that fit, also where segments hold few turns."""
    rng = random.Random(6)
    turns = [(i * step, "system" if i == system else ("user", "assistant")[i % 2], " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5)))) for i in range(40)]
    df = spark.createDataFrame([(c, *t) for c in (1, None) for t in turns], "conv_id long, turn long, role string, text string")
    budget, history, segment = 60, 25, 7
    firsts = [w for w in chat.windows(df, budget, history, segment).collect() if w.window == 0]
    assert len(firsts) == 2 * len({t // segment for t, *_ in turns})
    for w in firsts:
        before, want, room = [x for x in turns if x[0] < w.segment * segment], [], history
        head = next((x for x in before if x[1] == "system"), None)
        for x in reversed(before):
            if x is head or (room := room - chat.token_count(x[1], x[2])) < 0:
                break
            want.insert(0, x[1:])
        assert list(chat.read_back(w.text[: w.new_at])) == ([head[1:]] if head else []) + want


# 7 quality rules


def test_quality_base(odd, docs, none):
    for df in (odd.select("doc_id", "text", "lang", "source"), docs):
        rows = df.collect()
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df).collect())
        want = Counter()
        for r in rows:
            t, w = r.text or "", words(r.text)
            lines = [x for x in t.split("\n") if words(x)]
            seen, covered = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
            for i in range(len(w) - 7):
                if seen[tuple(w[i : i + 8])] > 1:
                    covered.update(range(i, i + 8))
            want[(r.doc_id, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))] += 1
        assert got == want
    assert quality.judge(none).count() == 0 and quality.judge(odd).count() == len(ODD)


def test_quality_outliers(spark):
    rng = random.Random(8)
    usual = lambda: "\n".join(" ".join("x" * rng.randrange(2, 9) + rng.choice(["", "", ".", ","]) + str(rng.random()) for _ in range(12)) for _ in range(rng.randrange(4, 12)))
    rows = [(i, usual(), "en", "a") for i in range(300)] + [(1000 + i, "\n".join(" ".join(f"{rng.random()}$$$" for _ in range(12)) for _ in range(6)), "en", "a") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i] for i in range(60)), "a sixth of the rows, and yet outliers"
    assert sum(got[i] for i in range(300)) >= 297


@pytest.mark.parametrize("n", [5, 39])
def test_quality_small_groups(spark, n):
    """A source of any size is judged: its odd text goes, its usual ones stay."""
    rng = random.Random(n)
    usual = lambda: "\n".join(" ".join("x" * rng.randrange(2, 9) + rng.choice(["", "", ".", ","]) + str(rng.random()) for _ in range(12)) for _ in range(rng.randrange(4, 12)))
    odd_text = "\n".join(" ".join(f"{rng.random()}$$$" for _ in range(12)) for _ in range(6))
    rows = [(i, usual(), "en", "big") for i in range(300)] + [(1000 + i, usual(), "en", "small") for i in range(n - 1)] + [(2000, odd_text, "en", "small"), (3000, odd_text, "de", "other"), (3001, usual(), "de", "other")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(r.base_failed or r.distance is not None for r in got.values())
    assert not got[2000].kept and not got[3000].kept and got[3001].kept
    assert sum(got[1000 + i].kept for i in range(n - 1)) >= n - 2 and sum(got[i].kept for i in range(300)) >= 297


@pytest.mark.parametrize("seed", range(3))
def test_quality_least_determinant(spark, seed):
    """Against every subset of nine of twelve vectors: the estimate is the one of the least determinant, or as good as it within a tenth; of a large group it is at least as good as from medians alone."""
    rng = np.random.default_rng(seed)
    parts = list(quality.FLOORS)
    small, large = rng.normal(size=(12, 5)), rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    small[:3] += 8
    large[:80] += 15
    rows = [(k, 0, *map(float, x)) for k, part in ((1, small), (2, large)) for x in part]
    kind = "level int, key long, " + ", ".join(f"{x} double" for x in parts)
    got = {r.level: r for r in quality.estimates(spark.createDataFrame(rows, kind), parts).collect()}
    floors = np.diag([f**2 for f in quality.FLOORS.values()])
    log_det = lambda x: np.linalg.slogdet(np.cov(x.T, bias=True) * quality.CONSISTENT + floors)[1]
    best = min(log_det(small[list(c)]) for c in itertools.combinations(range(12), 9))
    assert best - 1e-6 <= got[1].log_det <= best + 0.1 and got[1].n == 12
    near, cov = np.median(large, axis=0), np.diag(np.median(np.abs(large - np.median(large, axis=0)), axis=0) ** 2)
    for _ in range(20):
        d = np.einsum("ij,jk,ik->i", large - near, np.linalg.inv(cov), large - near)
        taken = large[d <= np.sort(d)[299]]
        near, cov = taken.mean(axis=0), np.cov(taken.T, bias=True) * quality.CONSISTENT + floors
    assert got[2].log_det <= log_det(taken) + 0.05
    assert all(abs(getattr(got[2], f"m_{i}") - large[80:, i].mean()) < 1 for i in range(5)), "a fifth of outliers has no say"


# 8 line dedup


@pytest.mark.parametrize("broadcast, often, quoted", [(500_000, 100, 256), (0, 2, 3)])
def test_line_dedup(spark, monkeypatch, broadcast, often, quoted):
    """Also with everything shuffled, frequent fingerprints split, and quoted sources sent to several groups."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(line_dedup, "SAMPLED", 1 if often == 2 else 16)
    monkeypatch.setattr(line_dedup, "SAMPLED_LEAST", often)
    monkeypatch.setattr(line_dedup, "QUOTED", quoted)
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))
    passage, own = fresh(70), [fresh(rng.randrange(20, 200)) for _ in range(40)]
    texts = [f"{t[: len(t) // 2]} {passage} {t[len(t) // 2 :]}" if i % 3 == 0 else t for i, t in enumerate(own)]
    texts += [texts[0], texts[1] + " and more", fresh(30) + "\n" + fresh(60) + "\n"]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].text == texts[0] and got[40].text == "" and got[40].n_words_removed == len(words(texts[0]))
    middle = " ".join(passage.split()[25:45])
    for i, t in enumerate(texts[:40]):
        if i % 3 == 0 and i:
            assert middle not in " ".join(got[i].text.split()) and got[i].n_words_removed >= 40
            rest = Counter(words(t)) - Counter(words(passage))
            assert not rest - Counter(words(got[i].text)), "only the passage goes"
        elif i % 3:
            assert got[i].text == t and got[i].n_words_removed == 0
    assert set(" ".join(texts).split()) == set(" ".join(r.text for r in got.values()).split()), "nothing is lost altogether"


def test_line_dedup_guarantee():
    """Runs of GRAM_WORDS + WINDOW - 1 words share a fingerprint, wherever they stand and whatever stands beside them."""
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        shared = [rng.randrange(2**60) for _ in range(line_dedup.GRAM_WORDS + line_dedup.WINDOW - 1)]
        sides = [[rng.randrange(2**60) for _ in range(rng.randrange(60))] + shared + [rng.randrange(2**60) for _ in range(rng.randrange(60))] for _ in range(2)]
        cuts = np.cumsum([0, *map(len, sides)])
        f, text, _ = line_dedup.fingerprints(np.array(sides[0] + sides[1], np.uint64), cuts)
        assert set(f[text == 0].tolist()) & set(f[text == 1].tolist())
        alone = [line_dedup.fingerprints(np.array(x, np.uint64), np.array([0, len(x)])) for x in sides]
        assert [x.tolist() for x in alone[0][::2]] == [f[text == 0].tolist(), line_dedup.fingerprints(np.array(sides[0] + sides[1], np.uint64), cuts)[2][text == 0].tolist()]
    few = np.arange(8, dtype=np.uint64)
    assert len(line_dedup.fingerprints(few, np.array([0, 0, 8, 8]))[0]) == 1 and len(line_dedup.fingerprints(few[:7], np.array([0, 7]))[0]) == 0


def repeated_words(texts, n=25):
    """For every text, which of its words lie in a run of n words that stands earlier (in an earlier text, or earlier in it)."""
    seen, out = set(), []
    for t in texts:
        w, gone = words(t), set()
        for i in range(len(w) - n + 1):
            if (run := tuple(w[i : i + n])) in seen:
                gone.update(range(i, i + n))
            seen.add(run)
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


@pytest.mark.parametrize("marks", [True, False])
def test_line_dedup_recall(spark, marks):
    """Against brute force: passages of 25 to 90 words of three earlier texts, whole or in parts, cut and joined anew."""
    rng = random.Random(21 + marks)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" + rng.choice(["", "", ".", ",", "\n"] if marks else [""]) for _ in range(n))
    texts = [fresh(rng.randrange(30, 200)) for _ in range(60)]
    for _ in range(140):
        own = []
        for _ in range(rng.randrange(1, 4)):
            w, n = rng.choice(texts).split(" "), rng.choice([25, 26, 40, 60, 90])
            at = rng.randrange(max(1, len(w) - n))
            own += [fresh(rng.randrange(10, 40)), " ".join(w[at : at + n])]
        texts.append(" ".join([*own, fresh(20)]))
    got = {r.doc_id: words(r.text) for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = repeated_words(texts)
    left = sum(len(got[i]) for i in got) - sum(sum((Counter(got[i]) & Counter(want[i])).values()) for i in got)
    repeats = sum(len(words(t)) - len(w) for t, w in zip(texts, want, strict=True))
    assert left <= 0.02 * repeats, (left, repeats)
    assert set(" ".join(texts).split()) == {w for x in got.values() for w in x}, "nothing is lost altogether"


def test_line_dedup_without_marks(spark):
    """A passage of 50 words inside longer lines without marks goes whole, wherever it stands; so does one of 25."""
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))
    passages = [fresh(n) for n in [50] * 40 + [25] * 20]
    texts = [f"{fresh(rng.randrange(5, 60))} {p} {fresh(rng.randrange(5, 60))}" for _ in range(2) for p in passages]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, p in enumerate(passages):
        assert got[i].text == texts[i]
        k = i + len(passages)
        assert got[k].n_words_removed == len(p.split()) and got[k].text.split() == texts[k].replace(p, "").split()


def test_line_dedup_of_several_sources(spark):
    """Paragraphs of 20 to 24 words that began in different texts, repeated together by two later ones."""
    rng = random.Random(13)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))
    texts, last = [], []
    for _ in range(30):
        parts = [fresh(rng.randrange(20, 25)) for _ in range(3)]
        texts += [f"{fresh(30)} {p} {fresh(30)}" for p in parts]
        last += [(f"{fresh(20)}\n{' '.join(parts)}\n{fresh(20)}", " ".join(parts)) for _ in range(2)]
    rows = list(enumerate(texts + [t for t, _ in last]))
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = [(got[len(texts) + i], t, p) for i, (t, p) in enumerate(last)]
    assert all(r.n_words_removed >= len(p.split()) - 14 for r, _, p in left)
    assert all(not Counter(words(t)) - Counter(words(p)) - Counter(words(r.text)) for r, t, p in left), "only the passage goes"
    assert set(" ".join(t for _, t in rows).split()) == set(" ".join(r.text for r in got.values()).split())


def test_line_dedup_odd(odd, none):
    out = line_dedup.dedup(odd)
    assert out.columns == [*odd.columns, "n_words_removed"]
    got = out.collect()
    assert len(got) == len(ODD) and sum(r.text is None for r in got) == 1
    by = {r.doc_id: r for r in got}
    assert by[9].text == ODD[10][1]
    left = by[8].text.split()
    assert left[-1] == "more" and len(left) < 20
    assert line_dedup.dedup(none).count() == 0


# 9 mixing


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, target, free = 1.5 * sum(sizes.values()), {}, list(order)
    while free:
        level = (goal - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not full:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 2.0 * sizes[s] for s in full}
        free = [s for s in free if s not in full]
    return target


def test_mixing(spark, docs):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "b", "c", "ü", None])) for i in range(3000)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, source string"), docs):
        source = {r.doc_id: r.source for r in df.collect()}
        got = mixing.mix(df).collect()
        assert len(got) == len(source) and got and sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
        sizes, taken, most = Counter(), Counter(), Counter()
        for r in got:
            s = source[r.doc_id]
            sizes[s] += r.size
            taken[s] += r.taken
            most[s] = max(most[s], r.size)
            assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        want = targets(sizes)
        for r in got:
            assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
        copies = mixing.mixed(df)
        assert copies.columns == df.columns and copies.count() == sum(r.copies for r in got)


def test_mixing_of_equal_rows(spark):
    """One id and text in two sources, and rows that are equal but for another column: each row as often as it is taken."""
    rows = [(1, "a b c", s, f"x{i}") for i, s in enumerate("abab")] + [(2, "d e", None, "y")] * 3 + [(i, "w " * (i % 7), "abc"[i % 3], "z") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    took, copies = mixing.mix(docs).collect(), mixing.mixed(docs).collect()
    want, got = Counter(), Counter()
    for r in took:
        want[r.doc_id, r.source] += r.copies
    for r in copies:
        got[r.doc_id, r.source] += 1
    assert +want == got and {tuple(r) for r in copies} <= set(rows)


def test_mixing_odd(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and sum(r.size for r in got) == sum(len(words(t)) for _, t, *_ in ODD)
    assert mixing.mixed(odd).count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


# 10 byte-level BPE


def test_bpe(spark, odd, none):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = ["a" * 3000, "  \n\n   " * 300, "don't 'r 're 'll" * 200, " " * 2000 + "x", "é" * 2000, "\u2028x " * 500, " x " * 500, None, ""] + ["".join(rng.choice(" ab'\n\t1.!éß漢\u2028  ") for _ in range(3000)) for _ in range(4)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    for chunk, overlap in ((64, 16), (500, 100), (byte_bpe.CHUNK, byte_bpe.OVERLAP)):
        encoded = byte_bpe.encode(rows, path, pattern, chunk, overlap)
        for r in byte_bpe.decode(encoded, path).collect():
            text = (texts * 2)[r.doc_id] or ""
            assert list(r.ids) == library.encode_ordinary(text) and bytes(r.bytes).decode() == text
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(odd, path, pattern), path)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(library.encode_ordinary(t or ""))) for d, t, *_ in ODD)
    assert byte_bpe.encode(none, path, pattern).count() == 0
