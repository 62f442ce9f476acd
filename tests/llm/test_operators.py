"""Each operator against a plain Python version, on the smallest table and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from strandline.llm import (
    backoff_scores, byte_pieces, digest_index, mixed_coder, near_copies, personal_data, secret_links, source_mix, toxicity, vantage_trees,
)
from strandline.llm.queries import _pattern, _tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("digest", T.StringType()), T.StructField("node", T.LongType()), T.StructField("band", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.StringType()),
    T.StructField("skey", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("ids", T.StringType()),
])
SPREAD = "a b c d e f g h i j k l m n o p q r s t u v w x y z "
TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "word", "Word", "word", "one two", "one two", "ONE TWO", "é à ü ß", "x" * 5000, "a" * 30 + " " + "0" * 40,
    SPREAD * 40, (SPREAD * 40).upper(), SPREAD + "extra", "token=abc token=token: abcdefgh", "AKIA" + "Q" * 20, "p" * 3 + "assword: hunter2hunter2",
    "mail me@example.com or +1 (555) 010-9999 at 10.0.0.256 10.0.0.25.1", "card 4111 1111 1111 1111", "\U0001f600 secret = s3cr3tvalue",
    "client_id=abcd1234efgh and Ab3" + "xY7" * 12 + " https://api.example.com/v1", "1.2.3.4.5.6.7.8", "@@a@b@c.d", "\x00 nul \x1f",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 4}", 1, "d", 1, 1, 1, 0.5, "x", "k", 1, "i") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "word", *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingle_set(t, words=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def near_brute(docs, words=2):
    sets = [(i, shingle_set(t, words)) for i, t in docs]
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if None not in (i, j) and a and b and label[i] < label[j] and 100 * len(a & b) >= 80 * len(a | b):
                    label[j], changed = label[i], True
    return sorted(((i, len(s), label[i], i is None or label[i] == i) for i, s in sets), key=str)


@pytest.mark.parametrize("which", ["odd", "none", "real"])
def test_near_copies(which, request):
    df = request.getfixturevalue(which)
    got = near_copies.near_components(df)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == near_brute([(r[0], r[1]) for r in df.select("doc_id", "text").collect()])


def test_near_copies_of_a_chain_and_a_group(spark):
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(40):  # each is near the next; far ones are not near each other
        texts.append(" ".join(base[k:] + [f"v{i}" for i in range(k)]))
    for k in range(60):  # near copies of one text, each with its own two words
        texts.append(" ".join([f"u{i}" for i in range(50)] + [f"own{k}", f"other{k}"]))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(near_copies.near_components(df), "doc_id", "n_shingles", "component_id", "kept") == near_brute(docs)


@pytest.mark.parametrize("block", [2, 2048])
def test_blocks_settle_what_stars_leave_open(spark, monkeypatch, block):
    """A bucket whose smallest member is near none of the rest, while the rest are near each other."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "_band_rows", lambda classes: classes.selectExpr("node", "7L AS band"))
    texts = ["lonely text of its own"] + [" ".join([f"a{i}" for i in range(40)] + [f"x{k}"]) for k in range(4)]
    texts += [" ".join([f"b{i}" for i in range(40)] + [f"y{k}"]) for k in range(4)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(near_copies.near_components(df), "doc_id", "n_shingles", "component_id", "kept") == near_brute(docs)


def test_pairs_are_confirmed_once_and_blocks_join_components(spark, monkeypatch):
    """Chains and groups that stars link in part and blocks the rest, in few tables: each costs a task a partition."""
    tables, write = [], near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, tag, keep=False: tables.append(tag) or write(df, tag, keep))
    monkeypatch.setattr(near_copies, "_band_rows", lambda classes: classes.selectExpr("node", "explode(array(-1L, node % 7)) AS band"))
    texts = ["lonely text of its own"]
    for c in range(3):
        texts += [" ".join([f"c{c}w{i}" for i in range(k, 60)] + [f"c{c}v{i}" for i in range(k)]) for k in range(12)]
    texts += [" ".join([f"a{i}" for i in range(40)] + [f"x{k}"]) for k in range(6)]
    docs = list(enumerate(texts))
    got = near_copies.near_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == near_brute(docs)
    assert tables.count("likely") == 2 and "pairs" in tables  # the stars once, the links of the blocks once
    assert len(tables) <= 21, tables


def test_short_texts_keep_all_their_links(spark):
    """Near pairs of 4 to 38 shingles: a text, and the same with words added."""
    texts = []
    for n in range(5, 33):
        for k in range(120 if n < 8 else 8):
            words = [f"t{n}k{k}w{i}" for i in range(n)]
            more = [f"more{n}k{k}i{i}" for i in range((n - 1) // 4 if k % 2 else 1)]
            texts += [" ".join(words), " ".join(words + more)]
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(0, len(texts), 2):  # texts of different pairs have no shingle in common
        if 100 * len(sets[a] & sets[a + 1]) >= 80 * len(sets[a] | sets[a + 1]):
            label[a + 1] = a
    got = rows(near_copies.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "component_id")
    assert got == sorted(enumerate(label), key=str)
    assert sum(i != x for i, x in enumerate(label)) == len(texts) / 2


@pytest.mark.parametrize("words", [2, 5])
def test_width_of_shingles(spark, words):
    """Ten scattered words of 200 changed leave two-word sets near, five-word sets not."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join("new" if i % 20 == 7 else w for i, w in enumerate(base)), " ".join(base + ["end"]), "a b c", "a b c", "a b c d"]
    texts += [" ".join(f"v{i}" for i in range(k)) for k in (20, 24, 26)]

    def cut(t):
        w = t.split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}

    sets, label = [cut(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(near_copies.near_components(df, words=words), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, len(s), x) for i, (s, x) in enumerate(zip(sets, label))), key=str)
    assert (label[1] == 0) == (words == 2)


def test_links_of_small_sets_at_the_limit(spark):
    """Random sets of 1 to 40 shingles against variants around the limit; rows repeat an id with other texts."""
    import random

    r, docs = random.Random(5), []
    for k in range(400):
        n = 1 + k % 40
        words = [f"g{k}w{i}" for i in range(n + 1)]
        docs.append((len(docs), " ".join(words)))
        for _ in range(2):
            other = words[: r.randint(max(1, n - n // 4), n + 1)]
            docs.append((len(docs), " ".join(other + [f"z{len(docs)}i{i}" for i in range(r.randint(0, 1 + n // 5))])))
    want = []
    for top in range(0, len(docs), 3):
        want += near_brute(docs[top : top + 3])  # different k have no shingle in common
    got = near_copies.near_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)
    linked = sum(not x[3] for x in want)
    assert 0 < linked < 700
    base = " ".join(f"w{i}" for i in range(30))
    same = spark.createDataFrame([(5, base), (5, "quite another text of this id"), (3, base + " more"), (7, "quite another text of this id")], "doc_id long, text string")
    assert rows(near_copies.near_components(same), "doc_id", "n_shingles", "component_id") == [(3, 30, 3), (5, 29, 3), (5, 5, 5), (7, 5, 5)]
    assert sorted(near_copies.survivors(same).collect()) == [(3, base + " more"), (5, "quite another text of this id")]


def test_scratch_tables_go(spark):
    import os

    folder = near_copies.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    near_copies.near_components(spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string")).collect()
    new = {x.split("-")[1] for x in set(os.listdir(folder)) - before}
    assert new == {"thin", "named"}


def test_estimate_is_corrected():
    a, b = near_copies.shingles(" ".join(f"a{i}" for i in range(90000))), near_copies.shingles(" ".join(f"b{i}" for i in range(90000)))
    s, used = near_copies.estimate(near_copies.registers(a), near_copies.registers(b), len(a), len(b))
    assert used == 512 and s < 0.01
    both = near_copies.np.union1d(a[:50000], b[:5000])
    s, _ = near_copies.estimate(near_copies.registers(a[:50000]), near_copies.registers(both), 50000, 55000)
    assert abs(s - 50 / 55) < 0.06


@pytest.mark.parametrize("which", ["odd", "none", "real"])
def test_exact_groups(which, request):
    df = request.getfixturevalue(which)
    docs = [(r[0], r[1] or "") for r in df.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in docs:
        groups[t].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, best[t], len(groups[t]), i is not None and i == best[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in docs]
    got = rows(digest_index.exact_groups(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=str)


def test_index_keeps_what_it_has_seen(spark):
    index = digest_index.fresh_index(spark)
    day = lambda *x: digest_index.digests(spark.createDataFrame(x, "doc_id long, text string"))
    index.add(day((1, "a"), (2, "b"), (3, "a")))
    index.add(day((4, "a"), (5, "c"), (6, "c")))
    assert sorted(r["keep_id"] for r in index.read().collect()) == [2, 3, 6]
    assert {r["keep_id"]: r["group_size"] for r in index.read().collect()} == {2: 1, 3: 3, 6: 2}
    later = digest_index.exact_groups(spark.createDataFrame([(9, "b"), (8, "new"), (10, "new")], "doc_id long, text string"), index)
    assert rows(later, "doc_id", "keep_id", "group_size", "kept") == [(10, 10, 2, True), (8, 10, 2, False), (9, 2, 2, False)]
    assert index.read().count() == 4
    plan = index.unseen(day((7, "a")).selectExpr("digest", "doc_id AS keep_id", "1L AS group_size"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    index.drop()
    assert not index.exists()


def test_exact_survivors(odd):
    kept = digest_index.survivors(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] or "" for r in kept.dropDuplicates().collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for t in TEXTS})


def test_exact_survivors_of_null_ids(spark):
    docs = [(None, "alone", "x"), (None, "twice", "x"), (None, "twice", "y"), (None, "shared", "x"), (1, "shared", "y"), (2, "shared", "z"), (3, "own", "x"), (None, None, "x")]
    kept = digest_index.survivors(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert rows(kept, "doc_id", "text") == sorted([(None, "alone"), (None, "twice"), (2, "shared"), (3, "own"), (None, None)], key=str)


def mix_brute(docs):
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in docs]
    total = defaultdict(int)
    for _, s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(total.values())
    while free and left > 1e-9:
        unit = left / sum(weight[s] for s in free)
        left, over = 0.0, set()
        for s in free:
            target[s] += unit * weight[s]
            if target[s] >= 2 * total[s]:
                left, over = left + target[s] - 2 * total[s], over | {s}
                target[s] = 2.0 * total[s]
        free -= over
    return sizes, total, target


@pytest.mark.parametrize("which", ["odd", "none", "real"])
def test_source_mix(which, request):
    df = request.getfixturevalue(which)
    docs = [(r[0], r[1], r[2]) for r in df.select("doc_id", "source", "text").collect()]
    sizes, total, target = mix_brute(docs)
    got = source_mix.mix(df).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), n) for i, _, n in sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = None if r["skey"] == "" else r["skey"][1:]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
    for s in total:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix(df.repartition(3)).collect()))


def passes_brute(docs, block):
    """(doc_id, text) of the mix in its order, for (doc_id, source, text) rows of different ids."""
    sizes, total, target = mix_brute(docs)
    text = {i: t for i, _, t in docs}
    order = sorted(total, key=lambda s: (s is not None, s or ""))
    quota = {s: math.floor(target[s] + 0.5) for s in order}
    need = {s: -(-quota[s] // block) for s in order}
    slots, slot_of, upper, u = sum(need.values()), defaultdict(dict), {}, 0
    for s in order:
        upper[s] = u = u + need[s]
    for k in range(1, slots + 1):
        at = math.floor((k * 0.6180339887498949 - math.floor(k * 0.6180339887498949)) * slots)
        s = next(s for s in order if at < upper[s])
        if len(slot_of[s]) < need[s]:
            slot_of[s][len(slot_of[s])] = k
    out = []
    for s in order:
        mine = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, source, n in sizes if source == s)
        at = 0
        for turn in range(2):
            for _, i, n in mine:
                if n and at < quota[s]:
                    words = re.findall(r"[^\x20\x09-\x0D]+", text[i])
                    take = min(n, quota[s] - at)
                    first = min(slot_of[s].get(r, slots + 1) for r in range(at // block, (at + take - 1) // block + 1))
                    out.append((first, i, turn, text[i] if take == n else " ".join(words[:take])))
                at += n
    return out, [i for i, _, n in sizes if not n]


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_has_its_passes_in_order(spark, block):
    docs = [(i, " ".join([f"t{i}"] * (1 + i % 9)), [None, "a", "b", "c"][0 if i < 9 else 1 if i < 40 else 2 if i < 300 else 3]) for i in range(600)]
    docs += [(1000, None, "a"), (1001, " ", None)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, size string, slot int")
    got = source_mix.mixed_documents(df, block)
    assert got.columns == df.columns
    found = [(r["doc_id"], r["text"]) for r in got.collect()]
    want, empty = passes_brute([(i, s, t) for i, t, s in docs], block)
    assert sorted(found[:-2]) == sorted(x[1::2] for x in want) and {x[0] for x in found[-2:]} == set(empty) == {1000, 1001}
    slot = {(i, t): [] for _, i, _, t in want}
    for first, i, _, t in want:
        slot[i, t].append(first)
    at = [min(slot[x]) for x in found[:-2]]
    late = [max(slot[x]) for x in found[:-2]]
    assert all(a <= b for a, b in zip(at, late[1:]))  # in the order of the slots
    words, (_, total, target) = Counter(), mix_brute([(i, s, t) for i, t, s in docs])
    for r in got.collect():
        words[r["source"]] += len((r["text"] or "").split())
    assert target["a"] > total["a"]
    for s in total:
        assert abs(words[s] - target[s]) <= 0.5 + 1e-9


def test_prefixes_of_the_mix_keep_the_shares(spark, real):
    """What the schedule is for: any beginning of the mix holds the sources nearly by their targets."""
    docs = [(i, "w " * (3 + i % 5), "abc"[0 if i % 10 < 5 else 1 if i % 10 < 8 else 2]) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows_ = source_mix.mix(df, 8).collect()
    target = {r["skey"]: r["target"] for r in rows_}
    slots = max(r["last_slot"] for r in rows_ if r["last_slot"])
    mixed = [(r["source"], len(r["text"].split())) for r in source_mix.mixed_documents(df, 8).collect()]
    for share in (0.1, 0.3, 0.6):
        words = Counter()
        for s, n in mixed:
            if sum(words.values()) >= share * sum(target.values()):
                break
            words[s] += n
        for key in target:
            assert abs(words[key[1:]] / sum(words.values()) - target[key] / sum(target.values())) < 0.01
    assert slots > 1000


def test_mix_tells_rows_of_one_id_apart(spark):
    """Source c is cut; all its rows have null ids or repeat one, some are equal in every column."""
    docs = [(None if i % 2 else 7, " ".join([f"t{i % 50}"] * (3 + i % 4)), "c") for i in range(100)] + [(i, "word " * 10, "ab"[i % 2]) for i in range(40)]
    docs += [(None, None, "c"), (None, "", "c"), (7, "same text", "c"), (7, "same text", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = source_mix.mix(df).collect()
    taken = Counter()
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["skey"][1:]] += r["taken"]
    words = Counter()
    got = source_mix.mixed_documents(df).collect()
    for r in got:
        words[r["source"]] += len((r["text"] or "").split())
    assert words == taken and all(abs(taken[r["skey"][1:]] - r["target"]) <= 0.5 for r in found)
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mixed_documents(df.repartition(3)).collect()))
    assert source_mix.mixed_documents(df.limit(0)).collect() == []


def test_schedule_is_even(spark):
    shares = spark.createDataFrame([("a", 700), ("b", 200), ("c", 100), ("d", 0)], "skey string, quota long")
    slots = source_mix.schedule(shares, 1).orderBy("slot").collect()
    assert len(slots) == 1000
    for key, n in (("a", 700), ("b", 200), ("c", 100)):
        assert sorted(r["rank"] for r in slots if r["skey"] == key) == list(range(n))
        for upto in (100, 300, 500):
            assert abs(sum(r["skey"] == key for r in slots[:upto]) - n * upto / 1000) <= 6


@pytest.mark.parametrize("which", ["odd", "none", "real"])
def test_byte_pieces(which, request):
    import tiktoken

    df = request.getfixturevalue(which)
    path = _tokenizer("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=_pattern(), mergeable_ranks=byte_pieces.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in df.select("doc_id", "text").collect():
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = byte_pieces.round_trip(df, path, _pattern())
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    back = byte_pieces.decode(byte_pieces.encode(df, path, _pattern()), path, _pattern())
    assert sorted(bytes(r["raw"]) for r in back.collect()) == sorted((r[0] or "").encode() for r in df.select("text").collect())


def test_model_needs_every_byte():
    with pytest.raises(ValueError):
        byte_pieces.serialised_model({b"a": 0})


def secret_brute(t):
    t = t or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        out += [(m.start(), 0, m.end(), "assign")] * (len(m.group(2)) >= 6)
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        out += [(m.start(), 1, m.end(), "access")] * (len(m.group()) >= 20)
    for m in re.finditer(r"[0-9a-f]+", t):
        out += [(m.start(), 2, m.end(), "hex")] * (len(m.group()) >= 24)
    return sorted(out)


@pytest.mark.parametrize("which", ["odd", "none", "real"])
def test_secret_base(which, request):
    df = request.getfixturevalue(which)
    got = secret_links.digest(secret_links.scan(df)).collect()
    want = []
    for i, t in df.select("doc_id", "text").collect():
        s = secret_brute(t)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want.append((i, *(sum(x[3] == k for x in s) for k in ("assign", "access", "hex")), hashlib.sha256(listed.encode()).hexdigest()))
    cols = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == sorted(want, key=str)


def linked_brute(t):
    """Weak parts that meet no base part and have their complement with at most 400 characters between."""
    base = [(k, a, b) for a, _, b, k in secret_brute(t)]
    token = r"[A-Za-z0-9+/_-]"
    weak = [("weak_secret", *m.span()) for m in re.finditer(rf"(?<![A-Za-z0-9+/_=-]){token}{{32,}}(?!{token})", t)
            if re.search("[0-9]", m.group()) and re.search("[A-Z]", m.group()) and re.search("[a-z]", m.group())]
    weak += [("weak_ident", *m.span()) for m in re.finditer(r"""(?i)(?<![A-Za-z0-9])(?:client|account|user|app|access)[_-]?(?:id|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{4,}""", t, re.A)
             if m.end() - m.start() >= 8]
    weak += [("endpoint", *m.span()) for m in re.finditer(r"(?i)(?<![A-Za-z0-9])(?:https?|postgres|mysql|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!&*+,;=%-]{4,}", t, re.A)
             if m.end() - m.start() >= 8]
    weak = [w for w in weak if not any(b[1] < w[2] and w[1] < b[2] for b in base)]
    near = lambda w, kinds: any(k in kinds and 0 <= max(a - w[2], w[1] - b) <= 400 for k, a, b in base + weak)
    needs = {"weak_secret": [("access", "weak_ident")], "weak_ident": [("assign", "hex", "weak_secret")], "endpoint": [("access", "weak_ident"), ("assign", "hex", "weak_secret")]}
    return sorted(w for w in weak if all(near(w, kinds) for kinds in needs[w[0]]))


def test_secret_links_need_their_complement(spark):
    weak = "Ab3" + "xY7" * 12
    docs = {
        1: f"{weak} alone", 2: f"client_id=abcd1234 then {weak}", 3: "client_id=abcd1234 alone", 4: "https://api.example.com/v1 alone",
        5: f"client_id=abcd1234 {weak} https://api.example.com/v1", 6: f"client_id=abcd1234 {'.' * 900} {weak}",
        7: f"AKIA{'Q' * 16} and {weak}", 8: f"{'.' * 399} client_id=abcd1234 {weak}", 9: f"client_id=abcd1234 {'Ab3' * 34}",
        10: f"{'Zz9' * 500} user_id: {'q' * 300}", 11: f"https://h.example/{'p/' * 150} client_id=abcd1234 {weak}",
    }
    def kinds_of(docs):
        got = secret_links.digest(secret_links.scan(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))).collect()
        return {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in got}

    got = kinds_of(docs)
    assert {i: [s[0] for s in x] for i, x in got.items()} == {
        1: [], 2: ["weak_ident", "weak_secret"], 3: [], 4: [], 5: ["weak_ident", "weak_secret", "endpoint"], 6: [],
        7: ["access", "weak_secret"], 8: ["weak_ident", "weak_secret"], 9: ["weak_ident", "weak_secret"], 10: ["weak_secret", "weak_ident"],
        11: ["endpoint", "weak_ident", "weak_secret"],
    }
    assert int(got[9][1][2]) - int(got[9][1][1]) == 102 and int(got[10][0][2]) == 1500 and int(got[11][0][2]) > 300
    import random

    r, parts = random.Random(2), [weak, "client_id=abcd1234", "https://api.example.com/v1", "AKIA" + "Q" * 16, "token: secretsecret", "0f" * 14, "x" * 700, "word " * 40, "Qw1" * 200]
    many = {i: " ".join(r.choice(parts) for _ in range(r.randint(1, 12))) for i in range(300)}
    for i, found in kinds_of(many).items():
        assert sorted((k, int(a), int(b)) for k, a, b in found if k in secret_links.WEAK) == linked_brute(many[i]), many[i]


def pii_brute(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((*m.span(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and personal_data.luhn(d):
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=personal_data._order)


@pytest.mark.parametrize("which", ["odd", "none", "real"])
def test_personal_data_base(which, request):
    df = request.getfixturevalue(which)
    want = []
    for i, t in df.select("doc_id", "text").collect():
        s = pii_brute(t)
        want.append((i, *(sum(x[2] == k for x in s) for k in personal_data.KINDS), hashlib.sha256(personal_data.listed(s).encode()).hexdigest()))
    got = personal_data.digest(personal_data.find(df))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=str)


def test_personal_data_base_on_random_strings():
    import random

    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice("a@.-1 25+(0é%") for _ in range(r.randint(0, 40)))
        assert sorted(personal_data.base_spans(t), key=personal_data._order) == pii_brute(t), t


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("mail john (at) example [dot] com now", "email", "john (at) example [dot] com"),
    ("jane at corp dot example dot org", "email", "jane at corp dot example dot org"),
    ("an hans     [ bei ]   beispiel (punkt) de bitte", "email", "hans     [ bei ]   beispiel (punkt) de"),
    ("marie arobase exemple point fr", "email", "marie arobase exemple point fr"),
    ("j at " + "h" * 80 + " dot org", "email", "j at " + "h" * 80 + " dot org"),
    ("ruf +vier neun drei null eins zwei drei vier fünf sechs sieben an", "phone", "+vier neun drei null eins zwei drei vier fünf sechs sieben"),
    ("\U0001f600 ｊohn@еxample.com", "email", "ｊohn@еxample.com"),
    ("call +one two three four five six seven eight nine zero one ok", "phone", "+one two three four five six seven eight nine zero one"),
    ("١٠.٠.٠.١", "ip", "١٠.٠.٠.١"),
    ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
])
def test_disguises_map_back_to_the_source(text, kind, part):
    _, added = personal_data.all_spans(text)
    assert [(k, text[a:b]) for a, b, k in added] == [(kind, part)]


def test_plain_prose_has_no_disguises():
    assert personal_data.all_spans("We met at noon, at one two and dot the i; he sat at home.") == ([], [])
    assert personal_data.all_spans("Un deux trois, nous irons au bois; am Punkt bei drei null.") == ([], [])


def test_disguises_of_long_texts_take_linear_time():
    import time

    for part in ("a at b ", "( at ", "+one two three ", "x.x.x.x ", "dot ", "1 ", "@", "[.] ", "é" * 9 + " "):
        start = time.process_time()
        personal_data.all_spans(part * 60_000)
        assert time.process_time() - start < 30, part


def test_added_spans_map_back(spark):
    """Random disguises of known parts: each is found whole, at its place in the source."""
    import random

    r, look = random.Random(8), {v: k for k, v in personal_data.LOOK_ALIKES.items() if v.isalpha()}
    digits = ["zero one two three four five six seven eight nine".split(), "null eins zwei drei vier fünf sechs sieben acht neun".split()]
    docs, want = [], []
    for i in range(200):
        name = "".join(r.choice("bcdfg") for _ in range(5))
        mail = r.choice([f"{name} (at) host[dot]org", f"{name} at host dot org", f"{name}@hоst.org", f"{name[:2]}{look['a']}@host.org"])
        number = " ".join(r.choice(digits[i % 2]) for _ in range(11))
        before, between = "é " * r.randint(0, 5), "; " + "☃" * r.randint(0, 3) + " then "
        docs.append((i, f"{before}{mail}{between}+{number} ."))
        at = len(before) + len(mail) + len(between)
        want.append((i, f"email:{len(before)}:{len(before) + len(mail)},phone:{at}:{at + 1 + len(number)}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(personal_data.digest(personal_data.find(df)), "doc_id", "spans") == sorted(want, key=str)


def test_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    tp = fp = fn = 0
    for i, y in labels.select("doc_id", "toxic").collect():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
        if r["held_out"]:
            tp, fp, fn = tp + (y and r["predicted"]), fp + (not y and r["predicted"]), fn + (y and not r["predicted"])
    assert tp / (tp + fp) >= 0.8 and tp / (tp + fn) >= 0.6


def test_toxicity_against_plain_python(real):
    """The query's scores are those of the plain formula: compressed lengths under either dictionary, counts, a logistic curve."""
    import zstandard

    rows_ = [(r["text"], int(r["doc_id"] % 3 == 0)) for r in real.collect() if r["text"]]
    rows_ = [(t + (" vile scum wretch" * 3 if y else ""), y) for t, y in rows_]
    model = toxicity.train(rows_)
    assert model.weights is not None and model.thresholds == sorted(set(model.thresholds)) and b"scum" in model.toxic
    spark = real.sparkSession
    docs = spark.createDataFrame(list(enumerate([t for t, _ in rows_] + ["", None, "scum", "x " * 30_000])), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, "doc_id").collect()}
    settings = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=3, min_match=3, target_length=16,
                                                   strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(window, content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        return len(zstandard.ZstdCompressor(compression_params=settings, dict_data=held).compress(window))

    for i, t in list(docs.collect())[::17] + [(len(rows_) + k, t) for k, t in enumerate(["", None, "scum"])]:
        w = (t or "").lower().encode().split()
        cut = [b" " + b" ".join(w[k : k + 8]) + b" " for k in range(0, len(w), 8)] or [b""]
        saved = [size(x, model.ordinary) - size(x, model.toxic + model.ordinary) for x in cut]
        x = []
        for limit in model.thresholds:
            k = sum(s >= limit for s in saved)
            x += [math.log(1 + k), k / len(cut)]
        over = sum(max(s - model.thresholds[1], 0) for s in saved)
        x += [math.log(1 + over), over / len(cut), max(0, *saved, 0) / 8, math.log(len(cut))]
        z = sum(c * (v - m) / s for c, v, m, s in zip(model.weights, x, model.mean, model.scale)) + model.weights[-1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    assert toxicity.classify(odd, labels).count() == odd.count()
    assert toxicity.classify(none, labels).count() == 0
    assert {r["score"] for r in toxicity.classify(odd, labels.limit(0)).collect()} == {0.0}


def backoff_brute(docs, corpus, own, order, alpha=0.4):
    """Every row scored by the corpus; by the other rows where the corpus is the documents themselves."""
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return w, Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))

    held = [grams(t) for _, t in corpus]
    counts, n = sum((g for _, g in held), Counter()), sum(len(w) for w, _ in held)
    out = []
    for i, t in docs:
        w, mine = grams(t)
        less = mine if own else Counter()
        words, total = n - len(w) * own, 0.0

        def log_s(gram):
            c = counts[gram] - less[gram]
            if len(gram) == 1:
                return math.log(max(c, 1) / max(words, 1))
            return math.log(c / (counts[gram[:-1]] - less[gram[:-1]])) if c else math.log(alpha) + log_s(gram[1:])

        for k in range(len(w)):
            total += log_s(tuple(w[max(0, k - order + 1) : k + 1]))
        out.append((i, len(w), round(total / len(w), 7) if w else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("which", "order", "block"), [("odd", 3, 12 << 20), ("none", 3, 12 << 20), ("real", 3, 50_000), ("real", 2, 12 << 20), ("odd", 4, 100)])
def test_backoff_scores(which, order, block, request, real, monkeypatch):
    monkeypatch.setattr(backoff_scores, "BUCKET_ENTRIES", 3000)
    monkeypatch.setattr(backoff_scores, "PIECE", block)
    df = request.getfixturevalue(which)
    docs = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]

    def same(got, want):
        found = sorted(((r["doc_id"], r["n_tokens"], None if r["score"] is None else round(r["score"], 7)) for r in got.collect()), key=str)
        for a, b in zip(found, want, strict=True):
            assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-6)

    same(backoff_scores.scores(df, order=order), backoff_brute(docs, docs, True, order))
    half = real.where("doc_id % 2 = 0")
    corpus = [(r[0], r[1]) for r in half.select("doc_id", "text").collect()]
    same(backoff_scores.scores(df, half, order=order), backoff_brute(docs, corpus, False, order))


def test_backoff_of_a_very_long_text(spark):
    """Longer than a chunk of hashing and than a block; a common word is one entry a block."""
    long = " ".join(f"w{i % 1000} the" for i in range(300_000))
    docs = [(1, long), (2, "the w1 the w2"), (3, None), (2**60 + 1, "w7 the " * 3), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(long) > backoff_scores.CHUNK
    got = {r["doc_id"]: r for r in backoff_scores.scores(df).collect()}
    assert set(got) == {1, 2, 3, 2**60 + 1, None} and got[1]["n_tokens"] == 600_000
    want = backoff_brute(docs[1:], docs, True, 3)
    for i, n, score in want:
        assert got[i]["n_tokens"] == n and (score is None or abs(got[i]["score"] - score) < 1e-6)
    frame = backoff_scores.pd.DataFrame({"block": [1], "lengths": [[8_000_000]], "texts": [backoff_scores._packed([b"the " * 2_000_000])]})
    rows_ = backoff_scores.entries(spark.createDataFrame(frame), 3, 4, True)
    assert sum(len(backoff_scores._from_planes(bytes(r["counts"]), "i4")) for r in rows_.collect()) == 3


def nearest_brute(rows, k=20):
    np = vantage_trees.np
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for i, q in good:
        if i % 20 == 0:
            found = sorted(((-float(q @ v), j) for j, v in good if j != i and len(v) == len(q)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return out


def test_nearest_is_exact_at_factor_one_and_close_beyond(spark, monkeypatch):
    monkeypatch.setattr(vantage_trees, "SHARD_ROWS", 150)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = nearest_brute([(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()])
    rows_ = vantage_trees.written(vantage_trees.usable(df), "vectors")
    index = vantage_trees.build(rows_, 150)
    queries_ = rows_.where("vec_id % 20 = 0")
    exact = sorted(tuple(r) for r in vantage_trees.search(index, queries_, 20, 1.0, 10).collect())
    assert [x[:3] for x in exact] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(exact, want))
    got = {(r["query_id"], r["vec_id"]) for r in vantage_trees.nearest(df).collect()}
    assert len(got & {(x[0], x[2]) for x in want}) >= 0.9 * len(want)


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]),
            (7, [3.0]), (8, [2.0, 1.0]), (9, [2.0, 1.0]), (9, [2.0, 1.0]), (40, [5.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<float>, shard string, rank int")
    got = sorted(tuple(r) for r in vantage_trees.nearest(df, factor=1.0).collect())
    assert got == nearest_brute(data)
    assert vantage_trees.nearest(df.limit(0)).collect() == []


@pytest.mark.parametrize("ids", [[], [0], [2**31 - 1, 0, 1, 2**30] * 500, [7] * 5000, list(range(3000)), [1, 2, 3] * 3000, list(range(17000, 0, -1)),
    [i * i % 50021 for i in range(40000)], [i % 7 * (1 << i % 29) for i in range(20000)]])
def test_coder_round_trip(ids):
    np = mixed_coder.np
    held = mixed_coder.encode_ids(np.array(ids, dtype=np.int64))
    assert mixed_coder.decode_ids(held).tolist() == ids


def test_coder_finds_damage():
    np = mixed_coder.np
    held = bytearray(mixed_coder.encode_ids(np.arange(4000)))
    for at in (0, 6, 26, 40, len(held) - 1):
        bad = bytearray(held)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            mixed_coder.decode_ids(bytes(bad))
    assert len(mixed_coder.encode_ids(np.array([5, 9, 11] * 20000))) < 60000 * 4 / 8  # raw ids take four bytes


def test_coder_learns_within_a_block():
    """Far below the bits of the ids: what repeats, and what is merely frequent."""
    import random

    np, r = mixed_coder.np, random.Random(1)
    frequent = np.array([min(50000, int(r.paretovariate(0.8))) for _ in range(100_000)])
    counts = np.bincount(frequent)
    p = counts[counts > 0] / len(frequent)
    assert 8 * len(mixed_coder.encode_ids(frequent)) / len(frequent) < 1.4 * -(p * np.log2(p)).sum()
    text = [r.randrange(50_000) for _ in range(300)]
    assert 8 * len(mixed_coder.encode_ids(np.array(text * 200))) / 60_000 < 1.5


def test_blocks_stand_alone():
    np = mixed_coder.np
    ids = np.arange(3 * mixed_coder.BLOCK) * 7919 % 50_021
    whole, one = mixed_coder.encode_ids(ids), mixed_coder.encode_ids(ids[mixed_coder.BLOCK : 2 * mixed_coder.BLOCK])
    assert one[-100:] in whole  # the same bytes, wherever the block is


def test_tokens_of_long_units_and_a_full_cache(spark, monkeypatch):
    """Crosses every limit of the cache; documents beyond a segment."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(mixed_coder._Tokenizer, "MOST_UNITS", 50)
    monkeypatch.setattr(mixed_coder._Tokenizer, "TOGETHER", 1000)
    monkeypatch.setattr(mixed_coder, "SEGMENT_IDS", 20_000)
    plain = Tokenizer.from_file(_tokenizer("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    texts = ["x" * 9000, " ".join(f"word{i}" for i in range(12_000)), "a\u00a0b\u2003c " * 300, "\n\n \t" * 500, "ab" * 30_000 + " tail", "\x1c\x1d é" * 50]
    tokenizer = mixed_coder._Tokenizer(open(_tokenizer("byte_bpe_50k.json")).read(), _pattern())
    for text, found in zip(texts, tokenizer.encode(texts), strict=True):
        assert found.tolist() == plain.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(2**60 + i, t) for i, t in enumerate(texts)] + [(None, "last"), (5, "b"), (5, "a")], "doc_id long, text string")
    got = mixed_coder.read_ids(spark, mixed_coder.write_ids(df, _tokenizer("byte_bpe_50k.json"), _pattern())).orderBy("start").collect()
    want = [(None, "last"), (5, "a"), (5, "b"), *((2**60 + i, t) for i, t in enumerate(texts))]
    assert [(r["doc_id"], r["ids"]) for r in got] == [(i, plain.encode(t, add_special_tokens=False).ids + [0]) for i, t in want]


def test_units_of_words_are_learnt_once(monkeypatch):
    """A word is one unit whatever marks stand around it, and a full cache keeps what is met often."""
    monkeypatch.setattr(mixed_coder._Tokenizer, "MOST_UNITS", 12)
    tokenizer = mixed_coder._Tokenizer(open(_tokenizer("byte_bpe_50k.json")).read(), _pattern())
    asked, model = [], tokenizer.tokens_of
    tokenizer.tokens_of = lambda piece: asked.append(piece) or model(piece)
    for text in (" word, word. word! word\n", " word? señor, señor.", " (word) word7", " a b c d e f", " word. g h"):
        list(tokenizer.encode([text]))
    assert asked.count("Ġword") == 1 and asked.count("ĠseÃ±or") == 1 and asked.count(".") == 1


def test_units_against_the_library():
    """Random strings of all kinds of characters that a unit could end at."""
    import random

    from tokenizers import Tokenizer

    r, definition = random.Random(5), open(_tokenizer("byte_bpe_50k.json")).read()
    plain, tokenizer = Tokenizer.from_str(definition), mixed_coder._Tokenizer(definition, _pattern())
    plain.encode_special_tokens = True
    common = [*"aZ09.'_-!  \n\t\r\x0bsStlvemd", "é", "×", "÷", "ß", "Ж", "’", "'ll", "  "]
    rare = ["\u0482", "中", "٣", "²", "ª", "\u0300", "😀", "ǅ", "\u200b", "—", "\x00", "\x7f", "\xa0", "\x85", "\x1c", "\u3000", "ʰ", "µ", "<|endoftext|>"]
    texts = ["".join(r.choice(common + rare * (i % 2)) for _ in range(r.randrange(40))) for i in range(4000)]
    for text, found in zip(texts, tokenizer.encode(texts), strict=True):
        assert found.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_new_units_go_to_the_library_together():
    """Plain units in few calls, others one by one, each with its own ids whatever the order."""
    from tokenizers import Tokenizer

    definition = open(_tokenizer("byte_bpe_50k.json")).read()
    plain, tokenizer = Tokenizer.from_str(definition), mixed_coder._Tokenizer(definition, _pattern())
    plain.encode_special_tokens = True
    asked, model, calls, together = [], tokenizer.tokens_of, [], tokenizer.together
    tokenizer.tokens_of = lambda piece: asked.append(piece) or model(piece)
    tokenizer.together = lambda texts, **how: calls.append(len(texts)) or together(texts, **how)
    texts = ["".join(f" w{'aeiou'[i % 5] * (i % 7)}{'xyz'[i % 3]}{k}se\u00f1or <|endoftext|>\n\x1bit's \u4e2d{i}" for i in range(k, k + 400)) for k in (0, 200, 900)]
    for text, found in zip(texts, tokenizer.encode(texts), strict=True):
        assert found.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert calls == [1] and asked
    assert not any("se" in piece for piece in asked)


def test_names_and_predictions_in_bulk():
    """The encoder's names and held predictions against dictionaries, id by id; symbols and fields are read back by the decoder."""
    np = mixed_coder.np
    ids = (np.random.default_rng(3).zipf(1.4, (5, 900)) % 60_000).astype(np.int32)
    name, new = mixed_coder._names_of(ids)
    last, before = np.zeros_like(name), np.zeros_like(name)
    last[:, 1:], before[:, 2:] = name[:, :-1], name[:, :-2]
    slot = mixed_coder._slot(last, before)
    two, one = mixed_coder._held_two(slot.astype(np.int32), name), mixed_coder._held_one(np.ascontiguousarray(name.T)).T
    for row in range(len(ids)):
        named, twos, ones = {}, {}, {}
        for i, x in enumerate(ids[row].tolist()):
            assert new[row, i] == (x not in named)
            k = named.setdefault(x, len(named))
            held, after = twos.get(slot[row, i], 0), ones.get(last[row, i], 0)
            assert (name[row, i], two[row, i], one[row, i]) == (k, held, after)
            twos[slot[row, i]] = 4 * k + 2 * (held & 1) + (held >> 2 == k)
            right, told = after & 3, after >> 2
            ones[last[row, i]] = 4 * told + min(right + 1, 3) if told == k else after - 1 if right else 4 * k
    flat = ids.reshape(-1)
    assert mixed_coder.decode_ids(mixed_coder.encode_ids(flat)).tolist() == flat.tolist()


@pytest.mark.parametrize("which", ["odd", "none", "real"])
def test_token_files(which, request, spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(mixed_coder, "SEGMENT_IDS", 30_000)
    df = request.getfixturevalue(which)
    plain = Tokenizer.from_file(_tokenizer("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    docs = [(r[0], plain.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in df.select("doc_id", "text").collect()]
    crc = lambda ids: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    path = mixed_coder.write_ids(df, _tokenizer("byte_bpe_50k.json"), _pattern())
    got = mixed_coder.read_digests(spark, path).orderBy("start").collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(x), crc(x)) for i, x in docs)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)
    assert sorted(tuple(r["ids"]) for r in mixed_coder.read_ids(spark, path).collect()) == sorted(tuple(x) for _, x in docs)


def pipeline_inputs(spark, real):
    from pyspark.sql import functions as F

    yield "real", real
    extra = ("score", "toxic", "digest", "node", "size", "skey", "ids", "n_tokens", "kept")
    rows_ = [(i, t, "en", None if i % 3 == 0 else f"s{i % 4}", len(t or ""), *[i] * len(extra)) for i, t in enumerate(TEXTS)]
    rows_ += [rows_[4], rows_[4], (None, "word", *rows_[0][2:]), (None, None, *rows_[0][2:]), (None, "only here", *rows_[0][2:])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} long" for x in extra)
    yield "odd", spark.createDataFrame(rows_, schema)
    yield "empty", spark.createDataFrame([], schema)
    yield "source only", real.withColumn("source", F.lit(None).cast("string"))


def test_pipeline_stages(spark, real):
    """Each stage against plain Python, on its own input."""
    import corpus_pipeline
    import tiktoken
    from pyspark.sql import functions as F

    plain = tiktoken.Encoding("own", pat_str=_pattern(), mergeable_ranks=byte_pieces.read_ranks(_tokenizer("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    for which, table in pipeline_inputs(spark, real):
        docs = corpus_pipeline.written(table, "in")
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.written(stage(spark, docs, SF), "out")
            held = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
            if name != "byte_bpe":
                assert out.columns == table.columns, (which, name)
                assert which == "empty" or out.count() > 0
            if name in ("toxicity", "exact_dedup", "near_dedup"):
                assert out.exceptAll(docs).isEmpty(), (which, name)
            got = rows(out, "doc_id", "text") if "text" in out.columns else None
            if name == "toxicity":
                labels = spark.read.parquet(f"{SF}/labels.parquet")
                model = toxicity.train(toxicity.labelled_sample(docs, labels))
                scored = model.scores([t or "" for _, t, _ in held])
                assert got == sorted(((i, t) for (i, t, _), x in zip(held, scored) if x < 0.5), key=str)
            if name == "exact_dedup":
                best = {}
                for i, t, _ in held:
                    best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
                assert sorted({(t or "", -1 if i is None else i) for i, t in got}) == sorted(best.items())
                assert Counter(t or "" for i, t in got if i is None) == Counter(t for t, i in best.items() if i == -1)
            if name == "near_dedup":
                assert [x[0] for x in got] == [x[0] for x in sorted(((i, t) for i, t in got), key=str)]
                kept = Counter(x[0] for x in near_brute([(i, t) for i, t, _ in held], 5) if x[3])
                assert Counter(x[0] for x in got) == kept, which
            if name == "mixing" and which in ("real", "source only"):
                want, empty = passes_brute([(i, s, t) for i, t, s in held], source_mix.BLOCK)
                assert got == sorted([(i, t) for _, i, _, t in want] + [(i, t) for i, t, _ in held if i in empty], key=str)
            if name == "byte_bpe":
                ids = [(i, plain.encode_ordinary(t or "")) for i, t, _ in held]
                want = [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids]
                assert rows(out, "doc_id", "n_tokens", "ids_sha256") == sorted(want, key=str)
            docs = out
