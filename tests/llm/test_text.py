"""Fingerprints, packing, personal data, toxicity, URL filters, mixing and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathmere.llm import fingerprints, mixing, packing, pii, toxicity, url_filter
from pathmere.llm import queries as registered
from llm_helpers import documents, odd_texts, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("rows", [odd_texts(), [(i, f"text {i} " * (i % 40)) for i in range(90)], [(1, "same"), (1, "also")], []])
def test_fingerprints_of_edits(spark, rows):
    got = fingerprints.against_edits(documents(spark, rows).repartition(4)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()] = None
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == set(want) and len(got) == len(rows)
    same = collections.defaultdict(set)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same[dict(rows)[r.doc_id] or "" if len(dict(rows)) == len(rows) else r.fingerprint].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(900)) for _ in range(6)]
    texts += [t[: len(t) // 2] + u[len(u) // 2 :] for t, u in zip(texts, texts[1:])] + ["", "a b", "rep " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketches = {r.doc_id: r.sketch for r in fingerprints.fingerprint(docs).collect()}
    for a in range(6):
        for b in range(6, 11):
            x, y = shingles(texts[a]), shingles(texts[b])
            assert abs(fingerprints.resemblance(np.array(sketches[a]), np.array(sketches[b])) - len(x & y) / len(x | y)) < 0.15
    pairs = spark.createDataFrame([(sketches[0], sketches[6]), ([], [])], "a array<long>, b array<long>")
    row = pairs.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("l"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n")).collect()
    assert row[0].l == fingerprints.resemblance(np.array(sketches[0]), np.array(sketches[6])) and abs(row[0].c - 0.5) < 0.2 and abs(row[0].n / 896 - 1) < 0.3
    assert (row[1].l, row[1].c, row[1].n) == (1.0, 1.0, 0.0)
    whole = fingerprints.fingerprint(docs).withColumn("k", F.lit(1))
    merged = fingerprints.merged(whole, ["k"]).collect()[0].sketch
    assert merged == sorted({h for s in sketches.values() for h in s})[: fingerprints.K]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    plain, fast = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER, limit=50)
    letters = list("aBcÉß'’sS tTreve.,!?- \n\t\x0b\x0c\x1c\x85\xa0\u0301é—×÷12９ΣσςÇ😀中mlld")
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert np.frombuffer(fast.encode(pa.array([text]))[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_finds_added_tokens_as_the_tokenizer_does():
    rng = random.Random(4)
    plain, fast = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER, limit=50)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", "<|", "|>", "one", "Two", " ", "\n", "é", "!", "\u0301", "'s", "😀"]
    texts = ["one two<|endoftext|>three", "", None, "<|endof", "text|>", "<|endoftext|>", "<|endoftext|><|startoftext|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)]
    for some in (texts[:1], texts[:7], texts[7:], texts):
        for text, ids in zip(some, fast.encode(pa.array(some, pa.string())), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert np.frombuffer(fast.encode(pa.array(texts[:1]))[0], "<u4").tolist() == [637, 1237, 49407, 2097]


@pytest.mark.parametrize("rows", [odd_texts(), [(i, "word " * (i * 37 % 5000)) for i in range(60)], [(1, "a"), (1, "a")], []])
def test_packing(spark, rows):
    plain = Tokenizer.from_file(TOKENIZER)
    got = packing.digests(documents(spark, rows).repartition(3), TOKENIZER).collect()
    docs, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        docs[r.doc_id, r.row].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(docs) == len(rows)
    left = collections.Counter(i for i, _ in rows)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    for (i, _), pieces in docs.items():
        left[i] -= 1
        pieces.sort()
        ids = texts[i][0]
        assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1]] and sum(p[1] for p in pieces) == len(ids) == pieces[0][3]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c, _ in pieces)
    assert not any(left.values())
    for pieces in bins.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1]] and sum(p[1] for p in pieces) <= packing.LENGTH


def test_first_fit_decreasing():
    lengths = np.random.default_rng(0).integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [100] * (b == len(room))
        want[i] = (b, 100 - room[b])
        room[b] -= lengths[i]
    assert all(want[i] == (bins[i], offsets[i]) for i in range(300))


def plain_spans(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_plain_spans_equal_the_patterns():
    rng = random.Random(0)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1.@-+ ()2%5_é04") for _ in range(rng.randrange(40)))
        assert sorted(pii.plain(text)) == sorted(plain_spans(text)), text


@pytest.mark.parametrize(("text", "found"), [
    ("mail john [at] example [dot] com now", ["john [at] example [dot] com"]), ("x john.smith at example dot com", ["john.smith at example dot com"]),
    ("jоhn@exаmple.com", ["jоhn@exаmple.com"]), ("call plus four nine one seven one two three four five six", ["plus four nine one seven one two three four five six"]),
    ("from one nine two dot one six eight dot zero dot one", ["one nine two dot one six eight dot zero dot one"]), ("４１１１ １１１１ １１１１ １１１１ ok", ["４１１１ １１１１ １１１１ １１１１"]),
    ("meet me at example.com", []), ("look at the dot on it", []), ("one two three", []), ("plain a@b.com only", []), ("zero one two three four five", []),
])
def test_disguised_spans(text, found):
    assert [text[a:b] for _, a, b in pii.disguised(text, pii.plain(text))] == found
    assert not found or pii.triggers(*pii.raw(pa.array([text])))[1][0]


def test_find_keeps_plain_spans(spark):
    rows = [*odd_texts(), (50, "a@b.co"), (51, "x (at) y.org +1 (017) 555-7713 " * 3), (50, "a@b.co")]
    got = pii.find(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {tuple(x) for r in got for x in r.spans if r.doc_id == 50} == {("email", 0, 6, True)}
    assert [(s.kind, s.base) for s in next(r.spans for r in got if r.doc_id == 51)] == [("email", False)] * 3 + [("phone", True)] * 3


def test_toxicity_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = registered.op7_toxicity(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert len(scored) > 500 and (scored.predicted == scored.toxic).mean() > 0.97
    assert scored[scored.predicted == 1].toxic.mean() > 0.97


def test_swapped_terms_lower_false_positives(spark):
    rng = random.Random(4)
    common = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic, w = i % 3 == 0, rng.choices(common, k=20)
        if toxic:
            w[3] = rng.choice(["idiot", "scum"]) if rng.random() < 0.7 else w[3]
        if rng.random() < (0.8 if toxic else 0.05):
            w[7] = "muslim"
        if rng.random() < 0.2:
            w[9] = "christian"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    sample, counts = toxicity.labelled(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), 1000, 1000)
    neutral = pa.array([" ".join([*rng.choices(common, k=20), "muslim"]) for _ in range(100)])
    rate = lambda fairness: float(toxicity.scores(neutral, toxicity.fit(sample, counts, fairness=fairness)).mean())
    assert rate(8.0) < 0.7 * rate(0.0)


def test_mentions_hardly_move_the_scores_of_the_query(spark, sf_dir):
    """The query's own sample: a mention given to clean texts may not move the score; without penalty it does."""
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    sample, counts = toxicity.labelled(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0, 4000, 8000)
    assert len(sample) > 200 and np.mean([given and len(own) and len(other) for *_, own, other, given in sample]) > 0.95
    texts = [r.text or "" for r in docs.limit(60).collect()]
    terms = [t for kind in toxicity.IDENTITY_TERMS for t in kind]

    def shift(fairness, **other):
        model = toxicity.fit(sample, counts, fairness=fairness, **other)
        logit = lambda rows: np.log(s := toxicity.scores(pa.array(rows), model)) - np.log1p(-s)
        plain = logit(texts)
        return max(np.abs(logit([f"{x} {t}" for x in texts]) - plain).max() for t in terms)

    assert shift(4.0) < 0.25  # the query's parameters
    assert shift(4.0, l1=0.05) < 0.25 and shift(4.0, l1=0.05) < 0.5 * shift(0.0, l1=0.05)


def test_scores_equal_a_plain_sum(spark, sf_dir):
    texts = [t or "" for _, t in odd_texts()] + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    rng = np.random.default_rng(0)
    model = toxicity.Model(-0.3, np.arange(0, 1 << toxicity.WEIGHT_BITS, 3), rng.normal(0, 0.05, len(range(0, 1 << toxicity.WEIGHT_BITS, 3))).astype(np.float32))
    table = dict(zip(model.features.tolist(), model.weights.tolist()))
    want = []
    for text in texts:
        found = set()
        for word in set(re.findall(rb"[a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))):
            found.update(toxicity.features(pa.array([word.decode()]))[0].tolist())
        want.append(1 / (1 + np.exp(-np.clip(model.bias + sum(table.get(f, 0.0) for f in found), -30, 30))))
    assert np.allclose(toxicity.scores(pa.array(texts), model), want, atol=1e-6)


def test_toxicity_repeated_rows_and_clashing_names(spark):
    rows = [(i % 40, ("vile idiot " if i % 40 < 10 else "kind garden ") + f"w{i % 7}") for i in range(80)]
    docs = documents(spark, rows).withColumns({"score": F.lit("x"), "row": F.lit(1), "toxic": F.lit("y")})
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(40)], "doc_id long, toxic int")
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i >= 10)


@pytest.mark.parametrize("labels", [[], [(4, 0), (5, 0)], [(4, 1), (4, None), (None, 1), (8, 0), (9, 2)]])
def test_toxicity_odd_input(spark, labels):
    docs = documents(spark, odd_texts())
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = docs.select(toxicity.score(docs, toxicity.train(docs, table)).alias("s")).collect()
    assert len(scores) == len(odd_texts()) and all(0 <= r.s <= 1 for r in scores)
    left = toxicity.drop_toxic(documents(spark, []), table)
    assert left.columns == docs.columns and left.count() == 0


def test_url_filter(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    urls = ["http://EN.Example.com/en/5", "http://www.example.com/en/5?x", "https://a.net/es/", "https://a.net/de/", "http://b.com", "http://b.com#x", None, "no scheme", "x://h\nh/p#q", "http://example.com/en", "https://free-casino-bets.example.org/x"]
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(rows, model).collect()}
    assert got[0] == ("en.example.com", "/en/5", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/5", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3][2] is None and got[4][:3] == ("b.com", "", None) and got[5][:3] == ("b.com", "", None)
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8][:2] == ("h\nh", "/p") and got[9][2:] == ("com/", "allow") and got[10][2:] == (None, "block")
    assert "Python" not in url_filter.judged(rows, model)._jdf.queryExecution().toString()
    assert url_filter.train(url_filter.labelled_urls(spark).limit(0)).bias < 0 and url_filter.judged(rows.limit(0), model).count() == 0


def test_url_classifier_learns_unseen_hosts(spark):
    held = [("https://m.{}.org/es/3", w, 1) for w in ("casino-royal", "best-pills", "bet-free", "ads-click")] + [("https://m.{}.org/es/3", w, 0) for w in ("bird-museum", "school-of-science", "open-library")]
    rows = spark.createDataFrame([(u.format(w), y) for u, w, y in held], "url string, y int")
    got = url_filter.judged(rows, url_filter.train(url_filter.labelled_urls(spark)), rules=(("zz/", "block"),)).collect()
    assert all((r.verdict == "block") == bool(r.row.y) for r in got)


def test_url_classifier_learns_from_paths_on_neutral_hosts(spark):
    told = [("casino/free-spins", 1), ("cheap-pills/order", 1), ("xxx/videos", 1), ("keygen/warez", 1), ("ads/banner", 1), ("recipes/soup", 0), ("docs/reference", 0), ("history/athens", 0), ("en/1234", 0)]
    hosts = ("http://www.maple-street.example.com/", "https://willowbrook.example.org/")
    rows = spark.createDataFrame([(h + p, y) for p, y in told for h in hosts], "url string, y int")
    got = url_filter.judged(rows, url_filter.train(url_filter.labelled_urls(spark)), rules=(("zz/", "block"),)).collect()
    assert [r.row.url for r in got if (r.verdict == "block") != bool(r.row.y)] == []


def test_url_parts_and_rules_equal_sql(spark, sf_dir):
    """Host, path, rule and the verdict of the rule, of all pages and of odd, long and repeated URLs."""
    odd = [None, "", "x", "a://B.Com", "a://com/en/?x", "s://Example.COM/en/1#f", "s://www.example.com/en/", "s://x.net/fr/", "q://y/?://net/es/", "h://net/es/" + "z" * 200_000, "h://net/es/" + "z" * 200_000]
    url = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").unionByName(spark.createDataFrame([(u,) for u in odd], "url string")).withColumn("host", F.lit(0))
    got = url_filter.judged(url, url_filter.Model(-1.0, (0.0,) * 8)).select("row.url", "host", "path", "rule", "verdict").toPandas()
    con = duckdb.connect()
    con.register("u", pd.DataFrame({"url": got.url}))
    fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h + p}'" for h, p in (("www.example.com", "/en/"), ("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"), ("com", "/")))
    want = con.execute(f"""
        with rests as (select url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from u),
        parts as (select url, lower(regexp_extract(rest, '^[^/?#]*')) host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests),
        ruled as (select *, case {fits} end as rule from parts)
        select *, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end verdict from ruled""").df()
    key = lambda frame: sorted(map(str, frame[["url", "host", "path", "rule", "verdict"]].astype(object).where(lambda f: f.notna(), None).itertuples(index=False)))
    assert key(got) == key(want)


def test_budgets_share_shortages_among_siblings_first():
    tree = {"a": (0.5, {"x": (0.5, {}), "y": (0.5, {})}), "b": (0.5, {"z": (1.0, {})})}
    assert mixing.budgets(tree, {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}, 400) == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    assert mixing.budgets(tree, {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}, 400) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 370}
    assert mixing.budgets(tree, {("a", "x"): 10, ("a", "y"): 20}, 400, 2) == {("a", "x"): 20, ("a", "y"): 40, ("b", "z"): 0}
    assert sum(mixing.budgets(tree, {("a", "x"): 101, ("a", "y"): 101, ("b", "z"): 101}, 100).values()) == 100


@pytest.mark.parametrize("bucket_rows", [10, 100_000])
def test_mixing_takes_prefixes_of_seeded_epochs(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(0)
    rows = [(i, "w " * rng.randrange(30), rng.choice(["en", "en", "en", "fr", None]), rng.choice(["src0", "src0", "src0", "src1", "src7", "zz", None])) for i in range(500)] + odd_texts()
    docs = documents(spark, rows)
    tree, levels = mixing.corpus_tree(), mixing.source_levels()
    got = mixing.mix(docs, levels, tree, 0.9, 3).collect()
    tokens, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang, source = (r[2:4] if len(r) > 2 else ("en", "src0"))
        if source and source.startswith("src") and lang:
            leaf = (list(mixing.DOMAINS)[int(source[3:]) % 4], lang, source)
            tokens[leaf] += len(words(r[1]))
            n[leaf] += 1
    plan = mixing.budgets(tree, dict(tokens), int(0.9 * sum(tokens.values())), 3)
    took = collections.Counter()
    for r in got:
        took[tuple(r.leaf)] += r.take_tokens
        assert r.take_tokens <= r.n_tokens
    assert {k: v for k, v in took.items() if v} == {k: v for k, v in plan.items() if v}
    per = collections.Counter((tuple(r.leaf), r.epoch) for r in got)
    for leaf, budget in plan.items():
        for epoch in range(1, budget // max(1, tokens[leaf]) + 1):
            assert per[leaf, epoch] == n[leaf]
    assert len(mixing.mix(docs, levels, tree, 0.9, 1).collect()) == len({str(r.row) for r in mixing.mix(docs, levels, tree, 0.9, 1).collect()})
    assert mixing.mix(documents(spark, []), levels, tree).count() == 0


def test_mixing_leaves_no_source_or_language_out(spark, tmp_path):
    import corpus_pipeline

    kinds = [("en", "src0"), ("en", "src20"), ("fr", "src77"), ("it", "src1"), (None, "src2"), ("en", "blog"), ("de", None), (None, None), ("es", "src99999999999")]
    docs = documents(spark, [(i, "w " * (i % 9 + 1), *kinds[i % len(kinds)]) for i in range(180)]).repartition(3)
    total = sum(i % 9 + 1 for i in range(180))
    whole = mixing.mix(docs, mixing.source_levels(), mixing.tree_of).collect()
    assert sorted(r.row.doc_id for r in whole) == list(range(180)) and sum(r.take_tokens for r in whole) == total
    assert {tuple(r.leaf) for r in whole} >= {("web", "en", "src20"), ("other", "en", "blog"), ("other", "unknown", "unknown"), ("books", "it", "src1")}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    drawn = registered.op10_mixing(spark, str(tmp_path)).collect()
    assert sum(r.take_tokens for r in drawn) == total and {(r.domain, r.lang) for r in drawn} >= {("other", "en"), ("other", "unknown"), ("books", "it"), ("news", "unknown")}
    kept = corpus_pipeline.mixed(spark, docs, "")
    assert sum(len(r.text.split()) for r in kept.collect()) == int(0.9 * total)  # the last document of a source is cut
    assert kept.columns == docs.columns and kept.where("source is null or lang is null or source = 'src20'").count() > 0
    given = mixing.budgets(mixing.corpus_tree(), {("web", "en", "src0"): 50, ("books", "fr", "src1"): 70}, 90, 2)
    assert {k: v for k, v in given.items() if v} == mixing.budgets(mixing.tree_of([("web", "en", "src0"), ("books", "fr", "src1")]), {("web", "en", "src0"): 50, ("books", "fr", "src1"): 70}, 90, 2)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns and 0 < docs.count() <= before, name
        assert docs.select("doc_id").distinct().count() == docs.count()
        before = docs.count()
    last = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("text, kind, part", [
    ("at one nine two.one six eight.one.one now", "ip", "one nine two.one six eight.one.one"),
    ("call +1 five five five 123 4567 today", "phone", "+1 five five five 123 4567"),
    ("host 192 dot 168 dot 1 dot 1 is up", "ip", "192 dot 168 dot 1 dot 1"),
    ("host 192[.]168[.]1[.]1 is up", "ip", "192[.]168[.]1[.]1"),
    ("host 192[ . ]168(dot)1[.]1 is up", "ip", "192[ . ]168(dot)1[.]1"),
    ("write bob ( at ) example.com", "email", "bob ( at ) example.com"),
    ("user three four five six at example dot com", "email", "three four five six at example dot com"),
    ("b\u043eb@example.com", "email", "b\u043eb@example.com"),
])
def test_disguises_that_need_chained_transducers(spark, text, kind, part):
    row = pii.find(documents(spark, [(1, text)])).first()
    assert (kind, part) in {(s["kind"], text[s["start"] : s["end"]]) for s in row.spans if not s["base"]}
    base = {(s["kind"], s["start"], s["end"]) for s in row.spans if s["base"]}
    assert base == set(pii.plain(text))


def test_sentences_with_numbers_are_no_identifiers(spark):
    texts = ["We saw one, two. Three came at noon, four at example.", "one two three four five", "Version 1.2 (see 3). Dot and at.", "a.b [.] c 1 [.] x"]
    assert all(not r.spans for r in pii.find(documents(spark, list(enumerate(texts)))).collect())
