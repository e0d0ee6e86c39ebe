"""Faults that show at size: what rare tokens, joins and long tables do, on small tables made for it."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__

QUERIES = __spark_entry__.queries()


def test_rare_tokens_have_no_nodes(spark, tmp_path):
    """A word below LEAST counts nothing, which needs more than ten million words."""
    talk = spark.range(10_002).select((F.col("id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") == 7, "zzz").otherwise(F.repeat(F.lit("ab "), 1000)).alias("text"))
    talk.write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["trie_nodes"](spark, str(tmp_path)).first().nodes == 3


@pytest.mark.parametrize("name", ["ngram_standalone", "ngram_position_confidence"])
def test_ngram_tables_are_not_sent(spark, name):
    """Only the row for each role may be broadcast; the counts grow with the text."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= (name == "ngram_standalone") and "SortMergeJoin" not in plan


def test_positions_have_their_longest_known_context(spark):
    from bytewren.operators import context as cx

    rng = np.random.default_rng(71)
    rows = [(str(rng.integers(0, 2)), [str(x) for x in rng.integers(0, 4, int(rng.integers(0, 30)))]) for _ in range(20)]
    df = spark.createDataFrame(rows, "role string, w array<string>")
    found = cx.position_confidences(cx.confidences(cx.token_grams(df, "w", "role"), "role"), "role")
    got = {(r.role, r.k): (r.n, r.c) for r in found.groupBy("role", "k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("confidence")).alias("c")).collect()}
    after = {}
    for role, w in rows:
        for i in range(len(w)):
            for k in range(1, min(i, 4) + 1):
                after.setdefault((role, k, tuple(w[i - k : i])), Counter())[w[i]] += 1
    want = {}
    for role, w in rows:
        for i in range(len(w)):
            for k in range(min(i, 4), 0, -1):
                seen = after[role, k, tuple(w[i - k : i])]
                if seen.total() >= 2:
                    n, c = want.get((role, k), (0, 0.0))
                    want[role, k] = n + 1, c + max(seen.values()) / seen.total()
                    break
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(math.isclose(got[k][1], want[k][1]) for k in want)


@pytest.mark.parametrize("options", [{}, {"chain": True}, {"match": True}])
def test_streams_in_step_cost_what_each_costs(options):
    """Streams folded together against the fold of each; before there was only the one after the other."""
    from bytewren.operators import lockstep, predictors

    rng = np.random.default_rng(72)
    words = [rng.bytes(int(rng.integers(1, 7))).hex().encode() for _ in range(9)]
    streams = [b" ".join(words[i] for i in rng.integers(0, 9, int(n))) for n in rng.integers(0, 30, 12)] + [b"", b"x", rng.bytes(60), b"AbAb abab ABAB. " * 6]
    streams.sort(key=len, reverse=True)
    for data, (bits, hits, total) in zip(streams, lockstep.costs(streams, **options)):
        each = list(predictors.stream_costs(data, **options))
        assert np.allclose(bits, np.sum([c for c, _ in each], axis=0) if each else 0, atol=1e-9)
        assert (hits, total) == (sum(n > 0 for _, n in each), sum(n for _, n in each))


def test_stream_keeps_its_bytes(spark, tmp_path):
    """Two batches of a stream cost what the whole costs, and the state holds no more than the bytes."""
    from bytewren.operators import predictors
    from bytewren.streaming import folds

    texts = [(1, 0, "some words come"), (2, 0, "other words"), (1, 1, " again, some words come"), (3, 0, None)]
    schema = "id long, turn long, text string"
    for i, part in enumerate((texts[:2], texts[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    folded = folds.fold_costs(stream, "id", "turn", "text")
    rows = folds.run_once(folded, "update", str(tmp_path)).collect()
    whole = b"some words come again, some words come"
    costs = [sum(c) for c, _ in predictors.stream_costs(whole)]
    got = sorted((r.stream_id, r.n_bytes, round(r.bits, 6)) for r in rows)
    assert got == [(1, 15, round(sum(costs[:15]), 6)), (1, 23, round(sum(costs[15:]), 6)), (2, 11, got[2][2]), (3, 0, 0.0)]


def test_running_sums_need_no_single_task(spark):
    from bytewren.operators import telemetry as tm

    rng = np.random.default_rng(73)
    rows = [(int(i), int(x)) for i, x in zip(rng.permutation(500) * 7 - 900, rng.integers(0, 9, 500))]
    made = tm.cumulative(spark.createDataFrame(rows, "id long, x long"), "id", 7, x="all")
    ordered = sorted(rows)
    assert sorted((r.id, r["all"]) for r in made.collect()) == [(i, sum(x for _, x in ordered[: n + 1])) for n, (i, _) in enumerate(ordered)]


BY_ROW = "longest_match match_hit_rate match_distribution order_1_prior_cost icm_last_byte delta_roundtrip delta_entropy plane_entropy detect_transform detect_transform_pages adaptive_encode bit_ones_by_position word_segments word_pair_contexts".split()


@pytest.mark.parametrize("name", BY_ROW)
def test_streams_stay_in_their_rows(spark, name):
    """Bytes are worked out where their row lies: no row for each byte, and nothing of them is shuffled."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    assert name == "match_hit_rate" or "Exchange" not in plan


def test_rows_of_one_id_are_one_stream(spark):
    """Histograms of rows with the same id add up, whether the id is null or not; other rows aren't moved."""
    from bytewren.operators import bytestats as bs

    df = spark.createDataFrame([(1, "aabb"), (2, "abcd"), (1, "ccdd"), (None, "xy"), (None, "z"), (3, None)], "id long, t string")
    found = {r.stream_id: r.entropy for r in bs.stream_entropies(df, "id", "t", planes=(1,)).collect()}
    assert found == pytest.approx({1: 2.0, 2: 2.0, None: math.log2(3)})
    assert sorted(r.n_sample for r in bs.detect_transform(df, "id", "t").collect()) == [0, 0, 0, 4, 8, 8]


def test_longest_matches_by_their_definition():
    from bytewren.operators import matches

    rng = np.random.default_rng(74)
    for data in [b"", b"abc", bytes(40), *(bytes(rng.integers(0, 3, int(n)).tolist()) for n in rng.integers(1, 400, 12)), bytes(rng.integers(0, 9, 150).tolist()) * 3]:
        length, sources = matches.longest_matches(data)
        for pos in range(len(data)):
            want, places = 0, []
            for n in matches.LENGTHS:
                if pos >= n:
                    seen = [q for q in range(pos - 1, n - 1, -1) if data[q - n : q] == data[pos - n : pos]][: matches.CANDIDATES]
                    if kept := [q for q in seen if q + 1 < pos]:
                        want, places = n, kept
            assert length[pos] == want and [q for q in sources[pos] if q >= 0] == places


def test_shorter_contexts_are_ends_of_the_longest(spark):
    from bytewren.operators import context as cx

    rng = np.random.default_rng(75)
    rows = [(str(rng.integers(0, 2)), bytes(rng.integers(0, 3, int(n)).tolist())) for n in rng.integers(0, 60, 12)] + [("0", None)]
    want = Counter()
    for lang, data in rows:
        for pos, b in enumerate(data or b""):
            for k in range(min(pos, 4) + 1):
                want[lang, k, int.from_bytes(data[pos - k : pos]), b] += 1
    got = cx.order_counts(spark.createDataFrame(rows, "lang string, c binary"), "c", "lang")
    assert {(r.lang, r.k, r.ctx, r.nxt): r.n for r in got.collect()} == want


def test_streams_coded_together_give_the_same_containers():
    """Streams coded in step against each alone, with halved counts, ties in rounding and all bytes."""
    from bytewren.operators import coder, coding

    rng = np.random.default_rng(76)
    streams = [b"", b"a", b"ab" * 2200, b"\xff" * 2500, bytes(range(256)) * 2, rng.bytes(700), *(bytes(rng.integers(97, 102, int(n)).tolist()) for n in rng.integers(1, 300, 9))]
    found = {i: (c, ok) for i, c, ok in coding.round_trips(streams)}
    assert [found[i] for i in range(len(streams))] == [(coder.compress(x), True) for x in streams]
    longest_first = sorted(streams, key=len, reverse=True)
    heads = [coder.read_container(coder.compress(x)) for x in longest_first]
    assert coding.decompress_all([h[3] for h in heads], [h[0] for h in heads]) == longest_first


@pytest.mark.parametrize("skip", [0.0, 0.02])
def test_hybrid_streams_in_step_cost_what_each_costs(spark, skip):
    from bytewren.operators import backbone, hybrid

    rng = np.random.default_rng(77)
    words = [rng.bytes(int(rng.integers(1, 4))).hex().encode() for _ in range(6)]
    tokens = {bytes([b]): b for b in range(256)} | {b" " + w: 256 + i for i, w in enumerate(dict.fromkeys(words))}
    config = backbone.Config(vocabulary=max(tokens.values()) + 1)
    weights = backbone.random_weights(config)
    data = [b" ".join(words[i] for i in rng.integers(0, 6, int(n))) for n in rng.integers(0, 14, 5)] + [b"", b"x"]
    df = spark.createDataFrame(list(enumerate(data)), "id long, c binary").coalesce(1)
    got = {r.stream_id: r for r in hybrid.hybrid_fold(df, "id", "c", tokens, config, weights, mixer="logistic", match=True, skip=skip).collect()}
    model = hybrid.Orchestrator(hybrid.TokenBackbone(backbone.Recurrent(config, weights), tokens))
    for i, x in enumerate(data):
        want = hybrid._totals(x, model, {"mixer": "logistic", "match": True, "skip": skip})
        r = got[i]
        assert (r.n_tokens, r.match_hits, r.match_len, r.skipped_tokens, r.skipped_bytes) == (want[0], *want[3:])
        assert math.isclose(r.bits, want[1], abs_tol=1e-6) and np.allclose(r.bit_costs, want[2], atol=1e-6)
