"""The learned operators against plain loops, clashing columns, and empty and repeated inputs."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oddsloom.llm import ann, chat, exactdup, langid, mixing, neardup, packing, quality, secrets, toxicity
from oddsloom.llm.queries import pack_config

WORDS = "river stone cloud window garden music letter street winter candle bridge forest".split()
RUDE = "zorg blim krat vexo".split()
CLASHES = ["label", "known", "key", "half", "grade", "score", "lang_pred", "spans", "piece", "length", "leader", "digest", "rep", "recipe", "keep_id", "block", "mix_pass", "__salt"]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def some_rows(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(5, 40))
        if i % 4 == 0:
            words[2:2] = rng.choices(RUDE, k=1 + i % 3)
        rows.append((i, " ".join(words), "en" if i % 2 else "fr", f"s{i % 3}"))
    return rows


def test_ftrl_is_a_plain_loop():
    rng = random.Random(5)
    config = quality.QualityConfig(dims=64, epochs=3)
    rows = [({rng.randrange(64): rng.random() + 0.1 for _ in range(rng.randint(1, 9))}, rng.randint(0, 1)) for _ in range(80)]
    index = np.concatenate([np.array(sorted(x)) for x, _ in rows])
    value = np.concatenate([np.array([x[i] for i in sorted(x)]) for x, _ in rows])
    at = np.concatenate([[0], np.cumsum([len(x) for x, _ in rows])])
    got = quality.ftrl(index, value, at, np.array([y for _, y in rows], float), config)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        if abs(z[i]) <= config.l1:
            return 0.0
        return -(z[i] - math.copysign(config.l1, z[i])) / ((config.beta + math.sqrt(n[i])) / config.alpha + config.l2)

    order = np.random.default_rng(config.seed)
    for _ in range(config.epochs):
        for r in order.permutation(len(rows)):
            x, y = {**rows[r][0], 64: 1.0}, rows[r][1]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / config.alpha * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(65)], atol=1e-9, rtol=0)


def test_cumulative_links_are_a_plain_loop():
    rng = random.Random(8)
    config = toxicity.ToxicityConfig(epochs=2)
    rows = [(sorted(rng.sample(range(30), rng.randint(1, 6))), rng.randint(0, 2)) for _ in range(120)]
    at = np.concatenate([[0], np.cumsum([len(x) for x, _ in rows])])
    weight, threshold = toxicity.fit_ordinal(np.array([g for _, g in rows]), np.concatenate([x for x, _ in rows]), at, 30, np.array([0.2, 0.9]), config)
    z, n, w, t = [0.0] * 30, [0.0] * 30, [0.0] * 30, [0.2, 0.9]
    order = np.random.default_rng(config.seed)
    for epoch in range(config.epochs):
        for r in order.permutation(len(rows)):
            x, k = rows[r]
            eta = sum(w[i] for i in x)
            above = [1.0, *[1 / (1 + math.exp(-(eta - c))) for c in t], 0.0]
            cell = max(above[k] - above[k + 1], 1e-9)
            upper, lower = above[k] * (1 - above[k]) / cell, above[k + 1] * (1 - above[k + 1]) / cell
            g = lower - upper
            if abs(g) < 1e-3:
                continue
            for i in x:
                old = n[i]
                n[i] += g * g
                z[i] += g - (math.sqrt(n[i]) - math.sqrt(old)) / config.rate * w[i]
                w[i] = 0.0 if abs(z[i]) <= config.l1 else -(z[i] - math.copysign(config.l1, z[i])) / ((1 + math.sqrt(n[i])) / config.rate + config.l2)
            move = config.threshold_rate / (1 + epoch)
            if k > 0:
                t[k - 1] -= move * min(1.0, upper)
            if k < 2:
                t[k] += move * min(1.0, lower)
            t = [t[0], max(t)] if t[1] < t[0] else t
    assert np.allclose(weight, w, atol=1e-9, rtol=0) and np.allclose(threshold, t, atol=1e-9, rtol=0)


def test_expected_severity_is_the_sum_of_plain_dot_products(spark):
    rows = some_rows()
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs_of(spark, rows), labels)
    weight = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))
    for r in toxicity.score_toxicity(docs_of(spark, rows), model).collect():
        index, _, _ = toxicity.features(pa.array([rows[r.doc_id][1]]), model.dims, model.prefix)
        p = [1 / (1 + math.exp(-(sum(weight.get(int(i), 0.0) for i in index) - c))) for c in model.threshold]
        assert r.score == pytest.approx(p[0], abs=1e-9) and r.expected_severity == pytest.approx(sum(p), abs=1e-9)
        assert r.predicted == int(r.doc_id % 4 == 0)


def test_no_text_grades_itself():
    toxic, clean = np.array([[3, 0], [0, 3], [2, 2], [5, 5]]), np.array([[0, 0], [0, 0], [0, 0], [1, 0]])
    chosen = toxicity.choose_features(np.arange(4), toxic, clean, 40, 400, toxicity.ToxicityConfig(telling_texts=2))
    assert chosen.telling[0].tolist() == [1, 2, 3] and chosen.telling[1].tolist() == [0, 2]


@pytest.mark.parametrize("labels", ["none", "all toxic", "no toxic"])
def test_one_sided_toxic_labels(spark, labels):
    rows = some_rows(60)
    marks = {"none": [], "all toxic": [(i, 1) for i in range(60)], "no toxic": [(i, 0) for i in range(60)]}[labels]
    model = toxicity.fit_toxicity(docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"))
    want = 60 if labels == "all toxic" else 0
    assert toxicity.score_toxicity(docs_of(spark, rows), model).where("predicted = 1").count() == want


def test_bitmask_filters_are_sets(spark):
    """Predictions equal those of exact n-gram sets, corrected for the filters' own false positives."""
    rng = random.Random(3)
    vocab = {"aa": ["".join(rng.choices("abcdefgh", k=7)) for _ in range(60)], "zz": ["".join(rng.choices("nopqrstu", k=7)) for _ in range(60)]}
    rows = [(i, " ".join(rng.choices(vocab[lang], k=30)), lang, "s") for i in range(120) for lang in [("aa", "zz")[i % 2]]]
    config = langid.LangIdConfig(slots=1 << 20, min_texts=1, min_share=0.0, min_ratio=0.0)
    model = langid.fit_filters(docs_of(spark, rows), config)
    grams = {lang: set() for lang in vocab}
    for _, text, lang, _ in rows:
        grams[lang] |= set(langid.grams_of(pa.array([text]), config.gram)[0].tolist())
    got = {r.doc_id: r for r in langid.predict_language(docs_of(spark, rows), model).collect()}
    for i, text, lang, _ in rows:
        own = langid.grams_of(pa.array([text]), config.gram)[0].tolist()
        hits = {n: sum(g in grams[n] for g in own) for n in vocab}
        assert got[i].lang_pred == max(hits, key=hits.get) == lang
        corrected = {n: max(0.0, (hits[n] - len(own) * f) / (1 - f)) for n, f in zip(model.languages, model.false_rate, strict=True)}
        assert got[i].score == pytest.approx(corrected[lang] / sum(corrected.values()), abs=0.02)
    empty = langid.fit_filters(docs_of(spark, []))
    assert {r.lang_pred for r in langid.predict_language(docs_of(spark, rows[:3]), empty).collect()} == {"und"}
    assert langid.predict_language(docs_of(spark, []), model).count() == 0


def test_clashing_columns_change_nothing(spark):
    """Every operator over a table with its own inner names as columns, and with repeated rows."""
    rows = some_rows(80) + [(7, some_rows(80)[7][1], "fr", "s1"), (200, None, "en", None), (201, "", None, "s0")]
    plain = docs_of(spark, rows)
    odd = clashing(plain)
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(80)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    labels = labels.withColumn("label", F.lit("clash")).withColumn("key", F.lit("clash"))

    def same(f):
        a, b = f(plain), f(odd)
        assert sorted(map(repr, a.select(*a.columns).collect())) == sorted(map(repr, b.select(*a.columns).collect()))
        return a

    assert same(lambda d: quality.score_quality(d, quality.fit_quality(d, labels))).count() == len(rows)
    assert same(lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels))).count() == len(rows)
    assert same(lambda d: langid.predict_language(d, langid.fit_filters(d))).count() == len(rows)
    assert same(secrets.find_secrets).count() == len(rows)
    assert same(lambda d: exactdup.exact_groups(d)).count() == len(rows)
    assert same(lambda d: neardup.near_classes(d)).count() == len(rows)
    assert same(lambda d: packing.pack(d, pack_config())).count() == len(rows)
    columns = plain.columns
    same(lambda d: mixing.mix_sources(d).select(*columns, "mix_shard", "mix_order"))
    same(lambda d: exactdup.drop_copies(d).select(*columns))
    same(lambda d: neardup.drop_near_duplicates(d).select(*columns))


def test_empty_tables(spark):
    none = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = quality.fit_quality(none, labels)
    assert quality.score_quality(none, weights).count() == 0
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)).count() == 0
    assert secrets.find_secrets(none).count() == 0 and secrets.find_secrets(clashing(none)).count() == 0
    assert packing.pack(none, pack_config()).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, vectors).count() == 0


def test_repeated_rows_are_scored_alike(spark):
    rows = some_rows(40)
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    twice = docs_of(spark, rows + rows)
    for found in (
        quality.score_quality(twice, quality.fit_quality(docs_of(spark, rows), labels)),
        toxicity.score_toxicity(twice, toxicity.fit_toxicity(docs_of(spark, rows), labels)),
        secrets.find_secrets(twice),
    ):
        assert found.count() == 80 and found.distinct().count() == 40


def test_chunks_of_any_script_are_cut_by_content(spark):
    """Text put before a long text moves its later cuts along, whatever the script."""
    rng = random.Random(1)
    scripts = {"japanese": "のにはをたがでてとしれさあいうか日本語学校時間人生", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "code": "abcxyz=(){};_ .\n"}
    texts = {n: "".join(rng.choices(a, k=20_000)) for n, a in scripts.items()}
    rows = [(2 * i + j, "moved " * j + t, n, "s") for i, (n, t) in enumerate(texts.items()) for j in (0, 1)]
    chunks = {}
    for r in exactdup._chunked(docs_of(spark, rows), "doc_id", "text").collect():
        chunks.setdefault(r.doc_id // 2, []).append(set(r.chunks))
    for a, b in chunks.values():
        assert len(a & b) >= 0.9 * len(a)


def test_ids_equal_the_tokenizers_file_over_unicode():
    from tokenizers import Tokenizer

    config = pack_config()
    full, own = Tokenizer.from_file(config.tokenizer), packing.DocumentTokenizer(config.tokenizer, config.ranks)
    rng = random.Random(9)
    ranges = [(0x20, 0x7F), (0x00, 0x20), (0x80, 0x250), (0x300, 0x370), (0x370, 0x600), (0x600, 0x780), (0x900, 0xE80), (0x1E00, 0x2100), (0x2000, 0x2070), (0x3000, 0x3100), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE00, 0xFFFD), (0x1F300, 0x1F900), (0xE0000, 0xE0080)]
    for _ in range(3000):
        a, b = rng.choice(ranges), rng.choice(ranges)
        text = "".join(chr(rng.randrange(*rng.choice((a, b)))) if rng.random() < 0.8 else rng.choice("  \n\t'sS1") for _ in range(rng.randint(0, 60)))
        assert own.encode(text).tolist() == full.encode(text, add_special_tokens=False).ids
    crc = zlib.crc32(np.append(own.encode("plain"), 0).astype("<u4").tobytes())
    assert crc == zlib.crc32(np.array([*full.encode("plain", add_special_tokens=False).ids, 0], "<u4").tobytes())


def test_recall_at_the_dimension_of_the_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(2)
    more = [(100_000 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 64)).astype(np.float32) / 8)]
    df = vectors.unionByName(spark.createDataFrame(more, vectors.schema))
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids, table = np.array(list(rows)), np.stack(list(rows.values()))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), ann.AnnConfig(shard_rows=1000)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((table - rows[q]) ** 2).sum(1))
        order = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits += len(found & set(order))
    assert len(got) == sum(q % 100 == 0 for q in rows) and hits >= 0.9 * 10 * len(got)


def test_queries_visit_few_shards_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 16)) * 4
    table = (centres[rng.integers(0, 24, 4000)] + rng.normal(size=(4000, 16)) * 0.6).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<float>")
    config = ann.AnnConfig(shard_rows=200, block=16)
    index = ann.build_index(df, config)
    centroids, visits = index.routes[16]
    assert len(centroids) == 20 and visits <= 5
    got = {}
    for r in ann.search(index, df.where("vec_id % 40 = 0"), config).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found & set([int(i) for i in np.argsort(((table - table[q]) ** 2).sum(1), kind="stable") if i != q][:10])) for q, found in got.items())
    assert len(got) == 100 and hits >= 0.95 * 1000
    flat = ann.fit_route(rng.normal(size=(3000, 64)), 10, config)
    assert flat[1] >= 8


@pytest.mark.parametrize("few", [1, 3, 9])
def test_queries_of_small_clusters_get_all_their_rows(spark, few):
    """Four large clusters and a far small one: its queries still find ten each, the nearest of the large ones among them."""
    rng = np.random.default_rng(few)
    centres = rng.normal(size=(4, 16)) * 3
    table = np.concatenate([centres[rng.integers(0, 4, 4000)] + rng.normal(size=(4000, 16)) * 0.3, 60 + rng.normal(size=(few, 16)) * 0.1]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<float>")
    for seed in (17, 18, 19):
        config = ann.AnnConfig(shard_rows=1000, seed=seed)
        queries = df.where(f"vec_id >= 4000 or vec_id % 400 = 0")
        got = {}
        for r in ann.nearest(df, queries, config).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert len(got) == 10 + few and {len(v) for v in got.values()} == {10}
        for q in range(4000, 4000 + few):
            assert set(range(4000, 4000 + few)) - {q} <= set(got[q])
    outside = spark.createDataFrame([(-1, [500.0] * 16)], "vec_id long, embedding array<float>")
    assert ann.search(ann.build_index(df, config), outside, config).count() == 10


def test_centroids_are_visited_until_they_hold_enough():
    d = np.array([[0.0, 1.0, 2.0, 3.0, 4.0]])
    sizes = np.array([2, 0, 3, 20, 20])
    assert ann.visited_centroids(d, 1, sizes, 11) == [[0, 2, 3]]
    assert ann.visited_centroids(d, 4, sizes, 11) == [[0, 2, 3, 4]]
    assert ann.visited_centroids(d, 1, sizes, 99) == [[0, 2, 3, 4]]
    assert ann.visited_centroids(d, 1, np.zeros(5, int), 3) == [[]]


def test_a_graph_in_two_parts_gives_all_rows(spark):
    """Nodes that no walk reaches from where it starts are found all the same."""
    links = np.full((40, 4), -1, np.int32)
    links[:5] = np.arange(4)
    table = np.arange(40.0)[:, None] * np.ones(3)
    index = pa.table({"cluster": [0], "shard": [0], "dim": [3], "vectors": [table.tobytes()], "ids": [np.arange(40).tobytes()], "id_offsets": [np.arange(41).tobytes()], "level_nodes": [[np.arange(40, dtype=np.int32).tobytes(), np.array([0], np.int32).tobytes()]], "level_links": [[links.tobytes(), np.full((1, 4), -1, np.int32).tobytes()]]})
    queries = pa.table({"vec_id": pa.array([30], pa.int64()), "vector": pa.array([table[30].tolist()], pa.list_(pa.float32()))})
    found = ann._search_shard(index, queries, ann.AnnConfig(k=4)).to_pydict()
    assert found["vec_id"] == [29, 31, 28, 32]


def test_the_whole_pipeline_over_odd_tables(spark, sf, tmp_path):
    """run() itself: repeated rows, nulls and columns of inner names, and an empty table."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.orderBy("doc_id").limit(40)
    nulls = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0)], docs.schema)
    odd = first.unionByName(first.limit(9)).unionByName(nulls)
    clashing(odd.drop("source")).withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.lit("a"))).write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").cache()
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0 and out.where("doc_id >= 1000000").count() == 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n > 2048 or n <> end").count() == 0
    again = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert sorted(map(repr, again.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(repr, out.select("doc_id", "piece", "ids_crc32").collect()))
    out.unpersist()
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_components_by_either_join(spark, monkeypatch):
    rng = random.Random(12)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    df = spark.createDataFrame(links, "a long, b long")
    for bound in (200_000, -1):
        monkeypatch.setattr(neardup, "BROADCAST_LINKS", bound)
        assert {r.node: r.root for r in neardup.components(df).collect()} == want
