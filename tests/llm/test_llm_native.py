"""Exact dedup, chat formatting and source mixing on small inputs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.llm import chat, exactdup, mixing

DOC = "doc_id long, text string, source string, lang string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1) for i, t, s in rows], DOC)


LONG = "Some words of a Long text, ended by a dot. " * 400
ROWS = [(1, "Ab c", "x"), (2, "aB C", "x"), (3, "ÄB", "x"), (4, "äb", "x"), (5, None, None), (6, "", "x"), (7, LONG, "x"), (8, LONG.upper(), "x"), (9, LONG + "!", "x"), (9, LONG + "!", "x"), (None, "Ab c", "x"), (None, "lone", "x")]


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_exact_groups(spark):
    got = exactdup.exact_groups(documents(spark, ROWS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(ROWS)


def test_exact_groups_survive_clashing_identifiers(spark):
    weak = (lambda c: F.char_length(c) % 3, lambda c: c)
    got = exactdup.exact_groups(documents(spark, ROWS), identifiers=weak).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(ROWS)


def test_chunks_are_the_text(spark):
    texts = [LONG, "x" * 9000, "ä" * 5000 + " b", "\n" * 700 + LONG, "a"]
    df = documents(spark, [(i, t, "x") for i, t in enumerate(texts)])
    rows = exactdup._chunked(df, "doc_id", "text").select("doc_id", "norm", F.array_join("chunks", "").alias("again"), F.array_max(F.transform("chunks", F.char_length)).alias("most")).collect()
    assert all(r.norm == r.again and r.most <= 2048 for r in rows)


def test_drop_copies(spark):
    kept = exactdup.drop_copies(documents(spark, ROWS).withColumn("kept", F.lit(1)))
    assert sorted((r.doc_id or 0, r.kept) for r in kept.collect()) == [(0, 1), (0, 1), (2, 1), (3, 1), (4, 1), (6, 1), (8, 1), (9, 1)]
    assert exactdup.exact_groups(documents(spark, [])).count() == 0
    assert exactdup.drop_copies(documents(spark, [])).count() == 0


TRICKY = ["", None, "plain", "</s>", "<s>[INST]", "~", "~~</s>~", "<~s>", "[~/INST] </s", "a\n\n[/INST] b", " [/INST]", "<", "</s" * 3, "ñ</s>日本", "x" * 50_000 + "</s>" + "~" * 999]


def test_chat_round_trip(spark):
    rows = [(c, i, role, t) for c, role in ((1, "user"), (2, "assistant"), (3, "[/INST] odd </s>"), (None, None)) for i, t in enumerate(TRICKY)]
    rows += [(4, None, "user", "no turn"), (4, 1, "assistant", "twice"), (4, 1, "assistant", "twice")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    want = {}
    for c, _, role, t in rows:
        want.setdefault(c, []).append((role or "", t or ""))
    for c, conv in want.items():
        assert [(t.role, t.text) for t in out[c].turns] == conv
    spoken = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    for c, conv in want.items():
        loss = "".join(t for role, t in conv if role == "assistant")
        assert spoken[c].loss_chars == len(loss)
        assert spoken[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert spoken[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in conv).encode()).hexdigest()
        assert spoken[c].formatted_chars == len(out[c].formatted)
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_parser_refuses_what_it_did_not_write(spark):
    bad = ["x<s>[INST] a [/INST]b</s>", "<s>[INST] a [/INST]b</s>x", "<s>[INST] a [/INST]b", "<s>[INST] a [/INST]b [INST]</s>"]
    df = spark.createDataFrame([(b,) for b in bad], "f string")
    assert df.where(chat.parse(F.col("f")).isNotNull()).count() == 0


def fill(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by handing on what stopped sources leave, again and again."""
    left = share * sum(sizes)
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while left > 1e-9 and open_:
        total = sum(weights[i % len(weights)] for i in open_)
        given = left
        left = 0.0
        for i in sorted(open_):
            target[i] += given * weights[i % len(weights)] / total
            if target[i] >= most * sizes[i]:
                left += target[i] - most * sizes[i]
                target[i] = most * sizes[i]
                open_.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 900, 30, 0, 70], [1000], [1, 1, 1, 10_000]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, mixing.MixConfig()).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(fill(sizes))


def test_split_quotas_are_exact():
    units = np.array([1000, 0, 7, 350])
    q = mixing.split_quotas(units, 7, 1)
    assert (q.sum(axis=0) == units).all() and q.sum(axis=1).max() - q.sum(axis=1).min() <= 1
    assert (q == mixing.split_quotas(units, 7, 1)).all()


def plain_mix(spark, docs, config):
    """The mix by plain loops: {(source, id): [(pass, shard), ...]}; hashes alone come from Spark."""
    rows = docs.select(
        "doc_id", "source", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")).alias("size"),
        F.xxhash64(F.lit(config.seed), "doc_id").alias("b"), F.xxhash64(F.lit(config.seed + 1), "doc_id").alias("place"),
    ).collect()
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [r for r in rows if r.source == s] for s in sources}
    targets = fill([sum(r.size for r in own[s]) for s in sources], config.weights, config.share, config.most)
    blocks = {s: max(config.blocks, -(-len(own[s]) // config.block_rows)) for s in sources}
    permuted = {r.id: r.h for r in spark.range(max(blocks.values(), default=0)).select("id", F.xxhash64(F.lit(config.seed + 2), "id").alias("h")).collect()}
    order, units = {}, {}
    for s, target in zip(sources, targets, strict=True):
        by_block = {}
        for r in own[s]:
            by_block.setdefault(r.b % blocks[s], []).append(r)
        ranks = sorted(by_block, key=lambda b: (permuted[b], b))
        total = sum(r.size for r in own[s])
        full = int(target // total) if total else 0
        rest = target - full * total
        draw = [(p, by_block[b]) for p in range(full) for b in ranks]
        if full < config.most:
            at, got = 0, 0
            while at < len(ranks) and got + sum(r.size for r in by_block[ranks[at]]) <= rest:
                got += sum(r.size for r in by_block[ranks[at]])
                draw.append((full, by_block[ranks[at]]))
                at += 1
            left = [r for b in ranks[at:] for r in by_block[b]]
            if at < len(ranks):
                part, places = [], sorted({r.place for r in by_block[ranks[at]]})
                for place in places:
                    here = [r for r in by_block[ranks[at]] if r.place == place]
                    if got + sum(r.size for r in here) > rest:
                        break
                    got += sum(r.size for r in here)
                    part += here
                if part:
                    draw.append((full, part))
                    left = [r for r in left if r not in part]
            near = [(abs(r.size - (rest - got)), r.place, r.doc_id) for r in left if r.doc_id is not None and abs(r.size - (rest - got)) < rest - got]
            if near:
                draw.append((full, [r for r in own[s] if r.doc_id == min(near)[2]]))
        order[s], units[s] = draw, len(draw)
    # A key is "=" and the source, or empty for null: the null source comes first in the tree.
    keys = [s for s in sorted(sources, key=lambda s: "" if s is None else f"={s}") if units[s]]
    out = {}
    if keys:
        at = {s: 0 for s in keys}
        for shard, quota in enumerate(mixing.split_quotas(np.array([units[s] for s in keys]), config.shards, config.seed)):
            for s, n in zip(keys, quota, strict=True):
                for p, rows_in in order[s][at[s] : at[s] + n]:
                    for i in {r.doc_id for r in rows_in}:
                        out.setdefault((s, i), set()).add((p, shard))
                at[s] += n
    return out


def mix_rows():
    rows = [(i, "w " * (1 + i * 7 % 50), "abc"[i % 3] if i % 11 else None) for i in range(1500)]
    return [*rows, (8, "w w", "c"), (8, "w w w", "c"), (None, "w", "a"), (None, "w w", None), (5000, None, "b"), (5001, "w " * 999, "lone"), (5002, "w " * 4, "lone"), (5003, "  ", "empty")]


@pytest.mark.parametrize("config", [mixing.MixConfig(), mixing.MixConfig(blocks=7, block_rows=100, shards=5), mixing.MixConfig(blocks=3, share=0.4, weights=(1.0,))])
def test_the_mix_is_what_plain_loops_draw(spark, config):
    docs = documents(spark, mix_rows())
    want = plain_mix(spark, docs, config)
    plan, sizes = mixing.plan_mix(docs, config)
    got = {}
    for r in mixing.deal(plan, sizes.select("doc_id", "source")).collect():
        got.setdefault((r.source, r.doc_id), set()).add((r.mix_pass, r.mix_shard))
    assert got == want
    taken = {}
    for r in mixing.taken_words(plan, sizes).collect():
        taken.setdefault(r.doc_id, set()).add((r.size, r.taken))
    for (_, i), places in want.items():
        assert i is None or any(t == s * len(places) for s, t in taken[i])


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), ("b" if i % 3 else "a") if i % 10 else None) for i in range(600)] + [(900, None, "a"), (901, "  ", "c")]
    docs = documents(spark, rows)
    plan, sizes = mixing.plan_mix(docs)
    got = mixing.taken_words(plan, sizes).collect()
    source = {i: s for i, _, s in rows}
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    for name in ("a", "b", None):
        own = [r for r in got if source[r.doc_id] == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2
    mixed = mixing.mix_sources(docs.withColumn("copies", F.lit("clash")).withColumn("key", F.lit("clash")).withColumn("block", F.lit(1)))
    assert mixed.columns == [*docs.columns, "copies", "key", "block", "mix_shard", "mix_order"]
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(counts.get(r.doc_id, 0) * r["size"] == r.taken for r in got)
    again = mixing.mix_sources(docs.repartition(7))
    assert again.select("doc_id", "mix_shard", "mix_order").exceptAll(mixed.select("doc_id", "mix_shard", "mix_order")).count() == 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_source_mixing_takes_what_the_tree_gives_its_shards(spark, tmp_path, monkeypatch):
    from oddsloom.llm.queries import op8_source_mixing

    documents(spark, mix_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_source_mixing(spark, str(tmp_path)).collect()
    assert sum(r.taken for r in got) > 0
    whole = mixing.shard_ranges
    monkeypatch.setattr(mixing, "shard_ranges", lambda units, config: whole(units, config).where("shard != 3"))
    assert sum(r.taken for r in op8_source_mixing(spark, str(tmp_path)).collect()) < sum(r.taken for r in got)
    monkeypatch.setattr(mixing, "shard_ranges", lambda units, config: whole(units, config).where("false"))
    assert sum(r.taken for r in op8_source_mixing(spark, str(tmp_path)).collect()) == 0


def test_many_sources_share_trees_and_joins_by_shuffle_give_the_same(spark, monkeypatch):
    docs = documents(spark, [(i, "w " * (1 + i % 9), f"s{i % 40}") for i in range(800)])
    config = mixing.MixConfig(tree_sources=7, blocks=8)
    columns = ["doc_id", "mix_shard", "mix_order"]
    first = sorted(map(tuple, mixing.mix_sources(docs, config).select(*columns).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, mixing.mix_sources(docs, config).select(*columns).collect())) == first


def test_the_pipeline_writes_the_mix_shard_by_shard_in_local_order(spark, sf, tmp_path):
    import corpus_pipeline

    docs = documents(spark, [(i, "w " * (1 + i * 7 % 50), "abc"[i % 3]) for i in range(1500)])
    want = [r.doc_id for r in mixing.mix_sources(docs).orderBy("mix_shard", "mix_order").select("doc_id").collect()]
    out = corpus_pipeline.mix(spark, docs, sf)
    assert out.columns == docs.columns
    assert [r.doc_id for r in out.collect()] == want
    out.write.parquet(f"{tmp_path}/mix")
    parts = sorted(tmp_path.glob("mix/part-*"))
    assert [r.doc_id for p in parts for r in spark.read.parquet(str(p)).collect()] == want
