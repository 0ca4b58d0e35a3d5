"""Operators 2, 3, 4 and 8 against plain brute force, on odd rows and on the small tables."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from girder.llm import bpe, common, mixing, repetition, simhash
from girder.llm.common import word_count
from girder.llm.components import components
from girder.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: list of (id, fingerprint); id of the smallest id reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = [(d, plain_fingerprint(t)) for d, t in docs]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(fps, plain_components(fps), strict=True))
    assert sorted(map(tuple, QUERIES["op2_simhash"](spark, SF).collect())) == want


def test_simhash_odd(spark, odd, empty):
    out = simhash.near_duplicates(odd).select("doc_id", "fp", "component_id").collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    fps = [(d, plain_fingerprint(t)) for d, t in docs]
    want = Counter((d, f if f < 1 << 63 else f - (1 << 64), c) for (d, f), c in zip(fps, plain_components(fps), strict=True))
    assert Counter(map(tuple, out)) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("largest", [2, 6, 40, 8192])
def test_links_in_crowded_keys(spark, largest):
    """Clusters around centres, with keys that have to be split once and twice."""
    rng = random.Random(largest)
    fps = {0, (1 << 64) - 1}
    for _ in range(4):
        near = [rng.getrandbits(64)]
        for _ in range(60):
            x = rng.choice(near)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            near.append(x)
        fps.update(near)
    fps = sorted(fps)
    signed = [x if x < 1 << 63 else x - (1 << 64) for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), largest=largest)
    for a, b in links.collect():
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
    got = {r.node: r.root for r in components(links).collect()}
    for i, root in enumerate(plain_components(list(enumerate(fps)))):
        assert got.get(signed[i], signed[i]) == got.get(signed[root], signed[root])
    assert len({got.get(x, x) for x in signed}) == len(set(plain_components(list(enumerate(fps)))))


# --- Mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len((r.text or "").encode().split())
    want, taken, largest = plain_targets(sizes), defaultdict(int), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    return taken, want


def test_mix_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op3_mix"](spark, SF).collect()
    check_mix(rows, docs)
    assert sorted(rows) == sorted(QUERIES["op3_mix"](spark, SF).collect())


def test_mix_odd(spark, odd, empty):
    docs = odd.select("doc_id", "text", "source").collect()
    check_mix(mixing.mix(odd).collect(), docs)
    repeats = Counter()
    for r in mixing.mix(odd).collect():
        repeats[r.doc_id, r.source] += r.repeats
    assert Counter((r.doc_id, r.source) for r in mixing.mixed(odd).collect()) == +repeats
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("most_broadcast", [50_000, 0])
def test_mix_of_copies(spark, monkeypatch, most_broadcast):
    """A source of copies of one row comes as near to its target as one of different documents, in any order of the rows."""
    monkeypatch.setattr(common, "MOST_BROADCAST", most_broadcast)
    monkeypatch.setattr(mixing, "_AT_ONCE", 7)
    rows = [(1, "one two three four five", "a")] * 100 + [(i, "w " * (i % 9 + 1), "b") for i in range(2, 200)] + [(i, "x y", None) for i in range(300, 330)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, take int")
    out = mixing.mix(df, weights=(1.0, 3.0, 2.0), share=1.3).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = plain_targets(sizes, (1, 3, 2), 1.3), defaultdict(int)
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 5 for s in sizes) and len(out) == len(rows) and 0 < want["a"] % sizes["a"]
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(5).orderBy(F.rand(3)), weights=(1.0, 3.0, 2.0), share=1.3).collect()))
    made = Counter()
    for r in out:
        made[r.doc_id, r.source] += r.repeats
    assert Counter((r.doc_id, r.source) for r in mixing.mixed(df, weights=(1.0, 3.0, 2.0), share=1.3).collect()) == +made


def test_places(spark, empty):
    values = ["b", "a", None, "ab", "é", "", "b", "😀", "Z", None]
    got = {r.value: r.place for r in common.places(spark.createDataFrame([(v,) for v in values], "x string")).collect()}
    order = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    assert got == {v: i for i, v in enumerate([*order, None])}
    assert common.places(empty.select("source")).count() == 0


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as Stub

    made = []
    on = lambda master: Stub(sparkContext=Stub(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append), conf=Stub(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="share"):
        common.shared_folder(on("spark://host:7077"))
    assert common.shared_folder(on("local[4]")) == made[0]


def test_words_are_bytes_split(spark, odd):
    for r in odd.select("text", word_count(odd.text).alias("n")).collect():
        assert r.n == len((r.text or "").encode().split())


# --- Repetition


def plain_repetition(text):
    words, lines = (text or "").encode().split(), [x for x in (text or "").split("\n") if x.encode().split()]
    found = defaultdict(list)
    for i in range(len(words) - 7):
        found[tuple(words[i : i + 8])].append(i)
    covered = {j for v in found.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n, chars = len(words), sum(len(w.decode()) for w in words)
    return n, chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def plain_maximal(words, least=4):
    """Substrings of ``least`` words or more that occur twice and can't be made longer on either side, with their places."""
    places, out = defaultdict(list), {}
    for k in range(least, len(words)):
        for i in range(len(words) - k + 1):
            places[tuple(words[i : i + k])].append(i)
        if not any(len(v) > 1 for g, v in places.items() if len(g) == k):
            break
    for gram, found in places.items():
        before = {words[i - 1] if i else None for i in found}
        after = {words[i + len(gram)] if i + len(gram) < len(words) else None for i in found}
        if len(found) > 1 and len(before) > 1 and len(after) > 1:
            out[gram] = found
    return out


def plain_verdict(text):
    """kept, by the definition of the rules alone."""
    if plain_repetition(text)[-1]:
        return False
    words = (text or "").encode().split()
    found = plain_maximal(words)
    covered = {j for gram, at in found.items() for i in at for j in range(i, i + len(gram))}
    longest = max(map(len, found), default=0)
    return len(covered) <= 0.3 * len(words) and longest <= 0.2 * len(words)


def test_repetition_query(spark):
    want = {r.doc_id: (*plain_repetition(r.text), plain_verdict(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_repetition"](spark, SF).collect()
    assert {r.doc_id: (*tuple(r)[1:7], r.kept) for r in rows} == want


def test_verdict_goes_beyond_the_base(spark):
    """On the larger table the method rejects texts that the base lets through, by its own count."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = repetition.repetition_rules(docs, keep=("doc_id", "text")).where("not base_failed and not kept").collect()
    assert found and not any(plain_verdict(r.text) for r in found)


def test_repetition_odd(spark, odd, empty):
    want = Counter((r.doc_id, *plain_repetition(r.text)) for r in odd.collect())
    got = repetition.repetition_rules(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert Counter(map(tuple, got)) == want
    assert repetition.repetition_rules(empty).count() == 0


@pytest.mark.parametrize("least", [1, 3, 4, 8])
def test_maximal_repeats_against_brute_force(least):
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        words = [b"w%d" % rng.randrange(rng.choice([1, 2, 5, 50])) for _ in range(rng.choice([0, 1, 7, 8, 9, 30, 60]))]
        texts.append(b" ".join(words + words[5:30] * rng.randrange(2)))
    for text, row in zip(texts, repetition.measure(texts, least=least), strict=True):
        want = plain_maximal(text.split(), least)
        assert (row[6], row[7]) == (max(map(len, want), default=0), len(want))
        covered = [j for s in row[8] for j in range(s["start"], s["end"])]
        assert len(covered) == len(set(covered)) == row[5] and set(covered) == {j for g, at in want.items() for i in at for j in range(i, i + len(g))}
        assert row[4] == plain_repetition(text.decode())[4]


def test_limits():
    rng = random.Random(5)
    words = [f"x{rng.random()}" for _ in range(1000)]
    passage = " ".join(words + words[:60])
    assert repetition.measure([passage.encode()])[0][-1]
    assert not repetition.measure([passage.encode()], max_longest=0.05)[0][-1]
    assert not repetition.measure([passage.encode()], max_covered=0.1)[0][-1]
    stutter = " ".join(w for w in words[:10] for _ in range(6))
    assert repetition.measure([stutter.encode()])[0][9:] == (False, False)


# --- BPE


def tik():
    import public_tokenizers
    import tiktoken

    data, pattern = bpe.vocabulary_of(None, "byte_bpe_multi_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={}), data, pattern


def digests(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_query(spark):
    encoding, _, _ = tik()
    want = {r.doc_id: digests(encoding, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_bpe"](spark, SF).collect()} == want


def test_bpe_odd(spark, odd, empty):
    encoding, data, pattern = tik()
    got = bpe.encode_decode(odd, data, pattern).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter((r.doc_id, *digests(encoding, r.text)) for r in odd.collect())
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_decode(empty, data, pattern).count() == 0


def test_bpe_random_words():
    encoding, data, pattern = tik()
    own = bpe.Replay(bpe.parse_ranks(data), pattern)
    rng = random.Random(11)
    pools = ["ab", "aeinrst ", "thenation", "éèàçñ日本語 ", "😀👍🏽‍\n\t ", "0123456789.,'s"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice(p) for _ in range(rng.randrange(400))) for p in pools for _ in range(100)] + ["a" * 30_000, " " * 3000, "ab" * 9000]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == encoding.encode_ordinary(t), t[:80]
        assert own.decode(ids) == t.encode()


def test_lower_rank_that_a_merge_makes_possible():
    """A pair that appears with a lower rank than the one in hand goes first, as it would alone."""
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"abc": 1, b"ab": 2, b"bca": 3, b"cab": 0}
    own = bpe.Replay(ranks, r"\S+|\s+")

    def alone(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if not best:
                return tuple(ranks[p] for p in parts)
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    assert own.replay([w.encode() for w in words]) == [list(alone(w.encode())) for w in words]


# --- Pipeline


def test_pipeline(spark):
    """Each stage against brute force on what the stage before it kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        stages.append(docs.collect())
    raw, good, single, mix, last = stages
    assert {r.doc_id for r in good} == {r.doc_id for r in raw if plain_verdict(r.text)}
    comps = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in good])
    assert sorted(r.doc_id for r in single) == sorted(set(comps))
    aims, taken, sizes = defaultdict(int), defaultdict(int), {r.doc_id: len(r.text.encode().split()) for r in single}
    for r in single:
        aims[r.source] += sizes[r.doc_id]
    for r in mix:
        taken[r.source] += sizes[r.doc_id]
    for s, t in plain_targets(aims).items():
        assert abs(taken[s] - t) <= max(sizes[r.doc_id] for r in single if r.source == s)
    encoding, _, _ = tik()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last) == Counter((r.doc_id, *digests(encoding, r.text)) for r in mix)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(r.doc_id for r in last)


def test_pipeline_odd(spark, odd, empty, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns from end to end, and an empty table."""
    import corpus_pipeline

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(12)]
    more = [(100 + i % 9, t, None if i % 4 else "de", [None, "a", "x"][i % 3], None) for i, t in enumerate(texts)] * 2 + [(None, texts[0], "en", "a", 1), (None, None, None, None, None)]
    docs = odd.unionByName(spark.createDataFrame([(*r, 1, 2, 3) for r in more], odd.schema))
    for name, df in (("odd", docs), ("empty", empty)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    rows = docs.collect()
    good = [r for r in rows if plain_verdict(r.text)]
    comps = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in good])
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert good and {r.doc_id for r in out} <= set(comps) and len({r.doc_id for r in out}) > 3
    encoding, _, _ = tik()
    known = {digests(encoding, r.text): r for r in good}
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in known for r in out)
    assert max(Counter((r.doc_id, r.decoded_sha256) for r in out).values()) <= 2
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_deduplicated_odd(spark, odd, empty):
    rows = simhash.deduplicated(odd).collect()
    docs = odd.collect()
    comps = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs])
    assert len(rows) == len(set(comps)) and {r.doc_id for r in rows} == set(comps)
    assert simhash.deduplicated(odd).columns == odd.columns and simhash.deduplicated(empty).count() == 0
