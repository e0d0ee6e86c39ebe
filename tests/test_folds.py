"""Folds, coder, tensors, vocabulary and streams: drawn cases against plain computations."""

import json
import math
import random
import struct

import numpy as np
import pytest

from bytewren.operators import coder, predictors
from bytewren.sources import tensors, vocabulary


def phrase(seed, n):
    rng = random.Random(seed)
    return bytes(rng.choice(b"lmnoprstuv") for _ in range(n))


def test_stretch_and_squash():
    rng = random.Random(30)
    for p in [rng.uniform(1e-4, 0.9999) for _ in range(200)] + [0.0, 1.0]:
        inside = min(max(p, predictors.LOWEST), predictors.HIGHEST)
        assert predictors.stretch(p) == pytest.approx(math.log(inside / (1 - inside)))
        assert predictors.squash(predictors.stretch(p)) == pytest.approx(inside)


def test_counter_is_the_decayed_fold():
    rng = random.Random(31)
    for _ in range(50):
        counter, n = predictors.Counter(), [0, 0]
        for _ in range(rng.randint(1, 300)):
            bit = int(rng.random() < 0.7)
            counter.add(bit)
            n = [int(np.float32(x) * np.float32(0.9)) for x in n]
            n[bit] = min(n[bit] + 16, 65_535)
            assert (counter.n0, counter.n1) == tuple(n)
            assert counter.p() == (n[1] + 8) / (sum(n) + 16)


@pytest.mark.parametrize("options", [{}, {"chain": True}, {"match": True}, {"mixer": "lstm"}, {"mixer": "hierarchical", "match": True, "expert": True}])
def test_costs_fall_on_repeats(options):
    one = phrase(32, 9)
    costs = [sum(c) for c, _ in predictors.stream_costs(one * 25, **options)]
    assert sum(costs[:9]) / 9 > 5 and sum(costs[-36:]) / 36 < 3
    flat = [sum(c) for c, _ in predictors.stream_costs(bytes([one[0]]) * 160, **options)]
    assert flat[0] > 6 and flat[-1] < 2


def test_noise_costs_about_eight_bits():
    data = random.Random(33).randbytes(500)
    assert sum(sum(c) for c, _ in predictors.stream_costs(data)) / len(data) > 7.5


def plain_costs(data):
    """The logistic mix by its definition: fifteen contexts, exact keys, one table for all."""
    slots, weights, words, word, after, out = {}, {}, [b"", b""], b"", {}, []
    for i, byte in enumerate(data):
        past = data[:i]
        contexts = [past[i - k :] if i >= k else None for k in range(9)]
        contexts += [bytes(past[i - o] for o in s) if i >= max(s) else None for s in predictors.SKIPS]
        contexts.append(after.get(past[-1], 0) if past else None)
        contexts += [(words[-1], word) if words[-1] else None, (words[-2], words[-1], word) if words[-2] else None]
        partial, costs = 1, []
        for j in range(8):
            bit = byte >> (7 - j) & 1
            keys = [None if c is None else (m, c, partial) for m, c in enumerate(contexts)]
            x = [predictors.stretch((slots[k][1] + 8) / (sum(slots[k]) + 16)) if k in slots else 0.0 for k in keys]
            w = weights.setdefault(partial, [1.0] * 15)
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            costs.append(-math.log2(max(p if bit else 1 - p, 1e-15)))
            weights[partial] = [a - 0.05 * (p - bit) * b for a, b in zip(w, x)]
            for k in keys:
                if k is not None:
                    old = [n * 9 // 10 for n in slots.get(k, (0, 0))]
                    old[bit] = min(old[bit] + 16, 65_535)
                    slots[k] = tuple(old)
            partial = partial * 2 + bit
        if past:
            after[past[-1]] = byte
        if byte in predictors.SEPARATORS:
            words, word = (words + [word], b"") if word else (words, b"")
        else:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
        out.append(costs)
    return out


def test_context_mixer_by_its_definition():
    rng = random.Random(34)
    data = b" ".join(rng.choice([b"Lorem", b"ipsum", b"dolor", b"x", b"\xc3\xa9t", b"sit."]) for _ in range(60))
    got = [c for c, _ in predictors.stream_costs(data)]
    assert np.array(got) == pytest.approx(np.array(plain_costs(data)))


def test_roster_and_observe():
    assert len(predictors.roster()) == 15
    a, b = predictors.ContextMixer(), predictors.ContextMixer()
    data = phrase(35, 40) * 2
    for byte in data:
        a.step(byte)
        b.observe(byte)
    assert a.learned() == b.learned() and a.parameters() > b.parameters() >= 0 and a.memory() > 0


def plain_match(data):
    """(length, places) of the longest context met before, the four latest places of it."""
    n = len(data)
    for k in (128, 64, 32, 16, 8, 4):
        places = [q for q in range(k, n) if data[q - k : q] == data[n - k :] and q + 1 < n] if n >= k else []
        seen = sorted(range(k, n + 1), reverse=True) if n >= k else []
        latest = [q for q in seen if data[q - k : q] == data[n - k :]][:4]
        places = [q for q in latest if q + 1 < n]
        if places:
            return k, places
    return 0, []


def test_match_model():
    rng = random.Random(36)
    for _ in range(12):
        block = bytes(rng.choice(b"kqz") for _ in range(rng.randint(5, 200)))
        data = block + rng.randbytes(3) + block[: rng.randint(4, len(block))] + block
        model = predictors.MatchModel()
        for i, byte in enumerate(data):
            k, places = plain_match(data[:i])
            p, n = model.predict()
            assert n == k and p.sum() == pytest.approx(1)
            votes = np.full(256, predictors.MatchModel.SMOOTH)
            for q in places:
                votes[data[q]] += k
            assert p == pytest.approx(votes / votes.sum() if places else np.full(256, 1 / 256))
            model.observe(byte)


def test_bit_probabilities():
    rng = np.random.default_rng(37)
    for byte in rng.integers(0, 256, 30).tolist():
        p = rng.dirichlet(np.full(256, 0.05))
        got, code = predictors.bit_probabilities(p, byte), f"{byte:08b}"
        for j in range(8):
            ones = sum(p[b] for b in range(256) if f"{b:08b}"[: j + 1] == code[:j] + "1")
            both = sum(p[b] for b in range(256) if f"{b:08b}"[:j] == code[:j])
            assert got[j] == pytest.approx(ones / both if both > 1e-10 else 0.5)
    assert predictors.bit_probabilities(np.zeros(256), 7) == [0.5] * 8


def test_lstm_mixer_learns():
    mixer, history = predictors.LstmMixer(3), predictors.History()
    for _ in range(256):
        p = mixer.mix([1.5, -1.0, 0.2], 1, history)
        mixer.update(1)
    assert p > 0.6 and mixer.t == 256 // mixer.SPAN
    deep = predictors.LstmMixer(3, layers=2)
    for _ in range(256):
        p = deep.mix([1.5, -1.0, 0.2], 1, history)
        deep.update(1)
    assert p > 0.6 and deep.parameters() > mixer.parameters()


def test_lstm_mixer_gradient():
    """What a span's backpropagation gives, against differences of the span's cost."""
    rng = np.random.default_rng(38)
    inputs = [(rng.normal(size=4).tolist(), int(rng.integers(0, 2))) for _ in range(6)]

    def run(change=None):
        mixer = predictors.LstmMixer(4, hidden=3, layers=2, seed=5)
        mixer.out = np.random.default_rng(1).normal(size=mixer.out.shape)
        if change:
            mixer.cells[change[0]].values[change[1]].flat[change[2]] += change[3]
        cost = 0.0
        mixer.frozen = True
        for x, bit in inputs:
            p = mixer.mix(x, 1, predictors.History())
            cost -= math.log(p if bit else 1 - p)
            mixer.update(bit)
        return cost, mixer

    _, mixer = run()
    grads = mixer.gradients()
    for layer in range(2):
        for k, value in enumerate(mixer.cells[layer].values):
            for i in rng.choice(value.size, 5).tolist():
                slope = (run((layer, k, i, 1e-5))[0] - run((layer, k, i, -1e-5))[0]) / 2e-5
                assert grads[layer][k].flat[i] == pytest.approx(slope, rel=1e-3, abs=1e-7)


def test_byte_expert_learns():
    e, pair = predictors.ByteExpert(), phrase(39, 2)
    for byte in pair * 110 + pair[:1]:
        e.observe(byte)
    p = e.predict()
    assert int(np.argmax(p)) == pair[1] and p.sum() == pytest.approx(1, abs=1e-3)


def test_token_ngrams():
    rng = random.Random(40)
    g, seen = predictors.TokenNgrams(6), []
    for _ in range(300):
        counts = {}
        for k in range(1, 5):
            if len(seen) >= k:
                follow = [seen[i] for i in range(k, len(seen)) if seen[i - k : i] == seen[-k:]]
                if follow:
                    counts[k] = follow
        bias, logits = np.zeros(6), np.zeros(6)
        for k, follow in counts.items():
            for t in set(follow):
                bias[t] += g.WEIGHTS[k - 1] * math.log((follow.count(t) + 0.01) / 0.01)
        if counts:
            best = counts[max(counts)]
            logits = np.array([math.log((best.count(t) + 0.01) / (len(best) + 0.06)) for t in range(6)])
        sure = [f for k, f in sorted(counts.items(), reverse=True) if len(f) >= 2]
        assert g.bias() == pytest.approx(bias) and g.logits() == pytest.approx(logits)
        assert g.confidence() == (max(map(sure[0].count, sure[0])) / len(sure[0]) if sure else 0.0)
        token = rng.choice([0, 1, 1, 2, 3, 5])
        g.observe(token)
        seen.append(token)
    costs = [b for _, b, _ in predictors.token_costs([5, 3, 1, 4, 4] * 40, 16)]
    assert sum(costs[100:]) < sum(costs[:100]) / 2


def test_range_coder():
    rng = np.random.default_rng(41)
    for n, size in ((256, 800), (90, 500), (65_536, 200), (2, 1500)):
        p = rng.dirichlet(np.full(n, 0.1))
        table = coder.cdf(p)
        assert table[-1] == coder.TOTAL and (np.diff(table) > 0).all()
        symbols = rng.choice(n, size, p=p)
        e = coder.Encoder()
        for s in symbols:
            e.encode(int(table[s]), int(table[s + 1]), int(table[-1]))
        data = e.finish()
        d = coder.Decoder(data)
        for s in symbols:
            found = int(np.searchsorted(table, d.position(int(table[-1])), "right")) - 1
            assert found == s
            d.take(int(table[s]), int(table[s + 1]), int(table[-1]))
        ideal = -np.log2(np.diff(table)[symbols] / coder.TOTAL).sum() / 8
        assert len(data) < ideal * 1.05 + 12


def test_container():
    rng = random.Random(42)
    for data in (b"", rng.randbytes(1), rng.randbytes(900), phrase(43, 30) * 20):
        assert coder.decompress(coder.compress(data, 16.0)) == data
    assert len(coder.compress(phrase(44, 3) * 1200)) < 900
    for bad in (b"", b"too short", rng.randbytes(60)):
        with pytest.raises(ValueError):
            coder.decompress(bad)


def test_token_codec():
    words = [b"over ", b"and ", b"out", b". ", b"roger "]
    tokens = {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate(words)}
    rng = random.Random(45)
    for data in (b"", b"q", b"".join(rng.choice(words) for _ in range(120)), rng.randbytes(80)):
        blob = coder.compress_tokens(data, tokens)
        assert coder.decompress_tokens(blob, tokens) == data
    text = b"".join(words) * 30
    assert len(coder.compress_tokens(text, tokens)) < len(text) / 4
    with pytest.raises(ValueError):
        coder.decompress_tokens(coder.compress(b"another format"), tokens)


def plain_calls(data):
    """Positions of call bytes whose four following bytes are taken as an address: none inside another's."""
    hits, i = [], 0
    while i < len(data) - 4:
        if data[i] in (0xE8, 0xE9):
            hits.append((i, data[i], struct.unpack_from("<i", data, i + 1)[0]))
            i += 5
        else:
            i += 1
    return hits


def test_call_transform():
    rng = random.Random(46)
    for _ in range(300):
        n = rng.randrange(120)
        data = bytearray(rng.choice(b"\xe8\xe9\0\0\0\x07\x50\xff") for _ in range(n))
        made, stats = coder.call_transform(bytes(data))
        want, hits = bytearray(data), plain_calls(data)
        for i, _, r in hits:
            if 0 <= r < n:
                struct.pack_into("<i", want, i + 1, (r + i) % n)
        inside = sum(0 <= r < n for *_, r in hits)
        assert made == bytes(want)
        assert stats == {"e8": sum(b == 0xE8 for _, b, _ in hits), "e9": sum(b == 0xE9 for _, b, _ in hits), "transformed": inside, "skipped": len(hits) - inside}
        assert coder.call_transform(made, True)[0] == bytes(data)


def test_tensor_values():
    rng = np.random.default_rng(47)
    x = np.concatenate([rng.normal(size=50), rng.normal(size=50) * 1e-7, [0, -0.0, np.inf, -np.inf]]).astype(np.float32)
    assert (tensors.decode(tensors.encode(x, "F32"), "F32") == x).all()
    with np.errstate(over="ignore"):
        assert (tensors.decode(tensors.encode(x, "F16"), "F16") == x.astype(np.float16).astype(np.float32)).all()
    short = tensors.decode(tensors.encode(x, "BF16"), "BF16")
    finite = np.isfinite(x)
    assert np.abs(short[finite] - x[finite]).max() <= np.abs(x[finite]).max() / 256 and (short[~finite] == x[~finite]).all()
    assert (short.view(np.uint32) & 0xFFFF == 0).all()
    with pytest.raises(ValueError):
        tensors.decode(b"", "I64")


def test_tensor_source(spark, tmp_path):
    x = np.random.default_rng(48).normal(size=(5, 3)).astype(np.float32)
    (tmp_path / "t.bin").write_bytes(tensors.pack({"a": ("F32", x), "b": ("BF16", np.float32([0, 0.5, -2]))}))
    spark.dataSource.register(tensors.TensorSource)
    rows = {r.name: r for r in spark.read.format("tensors").load(str(tmp_path / "t.bin")).collect()}
    assert rows["a"].shape == [5, 3] and rows["a"].data == x.ravel().tolist() and rows["b"].data == [0, 0.5, -2]
    again = tensors.read_tensors(spark.read.format("binaryFile").load(str(tmp_path / "t.bin")), "content", "path")
    assert sorted(r.name for r in again.collect()) == ["a", "b"]


def test_vocabulary(spark):
    lines = ["7 'q' 1", "2 b'\\xfe' 1", "9 'more words' 10", "66000 'far' 3", "nothing here", "4 '\\u00f6\\t' 3", "5 \"that's\" 6"]
    found = {r.token_id: bytes(r.bytes) for r in vocabulary.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert found == {7: b"q", 2: b"\xfe", 9: b"more words", 4: "ö\t".encode(), 5: b"that's"}
    assert vocabulary.tokens(b"more wordsq?", {v: k for k, v in found.items()}) == [9, 7, 0]


def test_hashes(spark):
    from bytewren.functions import hashes

    def plain(data, h=14695981039346656037, factor=1099511628211):
        for b in data:
            h = (h ^ b) * factor % 2**64
        return h

    rng = random.Random(49)
    data = [b"", *(rng.randbytes(rng.randint(1, 80)) for _ in range(60)), rng.randbytes(3000), None]
    assert hashes.fnv1a(b"") == 0xCBF29CE484222325 and hashes.fnv1a(b"a") == 0xAF63DC4C8601EC8C  # published values
    assert hashes.fnv1a_many(data[:-1]).tolist() == [plain(d) for d in data[:-1]]
    assert hashes.fingerprint(data[3], 5) == hashes.fingerprint(data[3][:5]) and len(hashes.fingerprint(data[3])) == 32
    rows = spark.createDataFrame(list(enumerate(data)), "i long, d binary").select("i", hashes.fnv1a_hex("d").alias("h"), hashes.fingerprint_hex("d").alias("f")).orderBy("i").collect()
    assert [r.h for r in rows] == [None if d is None else f"{plain(d):016x}" for d in data]
    assert [r.f for r in rows] == [None if d is None else hashes.fingerprint(d) for d in data]
    ids = [rng.randrange(70_000) for _ in range(20)]
    assert hashes.fnv1a_tokens(ids) == plain(ids)
    numbers = hashes.lcg(7, 1000)
    assert all(-1 <= x < 1 for x in numbers) and abs(sum(numbers)) < 100 and numbers[:5] == hashes.lcg(7, 5)


def test_snapshot(spark, tmp_path):
    from bytewren.sources import telemetry

    note = {"bpb_final": 2.25, "input_path": 'a "quoted" path'}
    data = telemetry.write_snapshot(note, {1: b"some section", 9: b""})
    assert telemetry.read_snapshot(data) == (note, {1: b"some section", 9: b""})
    for bad in (b"", data[:-1], data[:20], b"Q" + data[1:]):
        with pytest.raises(ValueError):
            telemetry.read_snapshot(bad)
    log = tmp_path / "run.jsonl"
    log.write_text(json.dumps({"ts": "1", "sec": 2.0, "bytes": 70, "bpb": 3.5, "bpb_w": 3.5, "bps": 35, "bit_costs": [0.3, 0.1], "match_hits": 2, "match_avg_len": 6.5}) + "\n")
    row = telemetry.read_log(spark, str(log)).first()
    assert row.bytes == 70 and row.bit_costs == [0.3, 0.1] and row.file.endswith("run.jsonl")


def test_state_sections_carry_on():
    """A fold that is saved and read again costs what it would have cost."""
    from bytewren.sources import telemetry

    data = phrase(50, 60) * 3
    for kind in ("logistic", "lstm", "hierarchical"):
        whole = predictors.ContextMixer(kind, externals=1)
        match = predictors.MatchModel()
        costs = []
        for i, byte in enumerate(data):
            if i == 100:
                saved = telemetry.write_snapshot({"bytes": i}, telemetry.state_sections(whole, match))
                _, sections = telemetry.read_snapshot(saved)
                again, seen = telemetry.restore_state(sections)
            external = [predictors.bit_probabilities(match.predict()[0], byte)]
            costs.append(whole.step(byte, external))
            if i >= 100:
                assert again.step(byte, [predictors.bit_probabilities(seen.predict()[0], byte)]) == costs[-1]
                seen.observe(byte)
            match.observe(byte)
