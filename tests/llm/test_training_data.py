"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gleanery.llm import garbled as G, mixing as X, packing as P, queries as Q, release_index as R, release_names as N, seen_keys as S, tokens as T
from gleanery.llm.components import components
from gleanery.llm.sorted_runs import RunStore
from gleanery.session import Scratch, list_names, scratch_path


# --- seen keys

SEEN = "id long, key string, _h string, extra int"


def seen_rows(n=400, hot=0.34, seed=1):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < hot else rng.choice([None, "", "k%d" % rng.randrange(150), "x" * 50_000 if i % 90 == 0 else "y%d" % i]), "clash", 1) for i in range(n)]


@pytest.mark.parametrize("bits", [64, 6])
def test_seen_before_equals_brute_force(spark, bits):
    rows = seen_rows()
    seen, want = set(), set()
    for i, key, *_ in rows:
        if key is not None:
            if key in seen:
                want.add(i)
            seen.add(key)
    df = spark.createDataFrame(rows[::-1], SEEN)
    got = [r.id for r in S.seen_before(df, "key", "id", batches=5, fan_out=2, hash_bits=bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_error_rate_counts_collisions(spark):
    rows = S.error_rate(spark.createDataFrame(seen_rows(), SEEN), "key", "id", hash_bits=6, batches=4).collect()
    assert sum(r.hash_only_wrong for r in rows) > 20 and all(r.wrong_answers == 0 for r in rows)


def test_seen_without_rows(spark):
    empty = spark.createDataFrame([], SEEN)
    assert S.seen_before(empty, "key", "id").count() == 0
    assert S.seen_before(spark.createDataFrame([(1, None, None, None), (2, None, None, None)], SEEN), "key", "id").count() == 0


def test_runs_are_merged_and_reopened(spark):
    """Runs of like size are merged without losing a row, in files that hold one bucket each; another session opens the store
    and adds to it; a look-up of few keys finds them."""
    path = scratch_path(spark, "seen-test")
    store = S.SeenKeys(spark, path, 4, fan_out=2)
    with Scratch(spark) as scratch:
        for b in range(5):
            batch = spark.createDataFrame([(b * 10 + k, f"k{b * 7 + k}") for k in range(10)], "id long, key string")
            store.add(batch, "key", "id", scratch)
            store.store.compact()
        assert 1 < len(store.store.runs["keys"]) <= 3 and all(len({n.split("_")[1] for n in names}) == len(names) for names in bucket_files(spark, store.store))
        store.store.close()
        other = spark.newSession()
        again = S.SeenKeys.open(other, path)
        assert sum(t.count() for t in again.store.tables("keys")) == 38
        checked = again.add(other.createDataFrame([(99, "k3"), (100, "new")], "id long, key string"), "key", "id", scratch)
        assert {r._first: r._same for r in checked.collect()} == {99: 3, 100: None}
        assert {r._key: r._first for r in again.lookup(["k3", "new", "none"]).collect()} == {"k3": 3, "new": 100}
        again.store.destroy()
    with pytest.raises(FileNotFoundError):
        S.SeenKeys.open(spark, path)


def bucket_files(spark, store):
    return [[n for n in list_names(spark, f"{store.path}/{r.folder}") if n.endswith(".parquet")] for runs in store.runs.values() for r in runs]


def test_runs_get_more_buckets_as_they_grow(spark):
    store = RunStore(spark, scratch_path(spark, "runs-test"), {"t": "k"}, 2, fan_out=2, bucket_bytes=1000)
    for k in range(2):
        store.commit({"t": store.stage("t", spark.range(k * 300, k * 300 + 300).select(F.col("id").alias("k")))})
    store.compact()
    (run,) = store.runs["t"]
    assert run.buckets >= 4 and store.table(run).count() == 600
    with store.trusted():
        probe = spark.range(0, 900, 7).select(F.col("id").alias("k"))
        assert probe.hint("merge").join(store.table(run).hint("merge"), "k").count() == len(range(0, 600, 7))
    store.commit({"t": store.stage("t", spark.range(0).select(F.col("id").alias("k")))})
    assert store.runs["t"] == [run]
    store.destroy()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=14))
def test_components_equal_union_find(spark, edges):
    parent = {}
    for a, b in edges:
        for n in (a, b):
            parent.setdefault(n, n)
        x, y = a, b
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        parent[max(x, y)] = min(x, y)
    root = lambda n: n if parent[n] == n else root(parent[n])
    with Scratch(spark) as scratch:
        got = components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    assert sorted((r.v, r.root) for r in got) == sorted((n, root(n)) for n in parent)


# --- releases


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("magnet:?xt=urn:btih:" + "AB" * 20 + "&dn=x", "https://seed.x.example/t/" + "ab" * 20 + "%2Etorrent#top", True),
        ("http://dl.x.example/get/7/n.torrent?ref=feed", " https://www.MIRROR.x.example:443/./get/7/n.torrent\n", True),
        ("http://dl.x.example/get/7/n.torrent", "http://dl.x.example/get/8/n.torrent", False),
        ("https://a/t/" + "ab" * 20 + ".torrent", "https://a/t/" + "ab" * 19 + "ac.torrent", False),
        ("https://a/download?id=3&%68ash=" + "0c" * 20, "https://b/download?hash=" + "0c" * 20 + "&id=4", True),
        ("magnet:?xt=urn:btih:" + "A" * 32, "magnet:?xt=urn:btih:" + "00" * 20, True),
    ],
)
def test_addresses(a, b, same):
    assert (N.canonical_address(a) == N.canonical_address(b)) is same
    assert N.canonical_address(None) is None and N.canonical_address("  ") is None


SPELLINGS = [
    "[Ab-Fan] Some Title of It S2 - 03v2 [1080p][HEVC]", "Some.Title.of.It.S02E03v2.1080p.x265-Ab-Fan", "Some_Title_of_It_S2_-_03v2_(1080p_H.265)_[Ab-Fan].mkv",
    "【AB-FAN】空森 / SOME TITLE OF IT 第2季 第03话v2 {1080p}{hevc}", "  ［Ab－Fan］ Some Title of It S２ － ０３v2 ［１０８０p］［HEVC］  [rehost]",
]


def test_spellings_of_a_name():
    assert {N.read_name(s) for s in SPELLINGS} == {("abfan|2|3|1080|hevc|2", "some title of it")}
    assert N.read_name(None) == (None, None) and N.read_name(" ") == (None, None) and N.read_name("Odd Name 12, 3") == ("?12|3", "odd name #, #")


def slip(title, rng):
    for _ in range(rng.choice([1, 1, 2])):
        i = rng.randrange(1, len(title) - 2)
        if " " in title[i - 1 : i + 2]:
            continue
        title = rng.choice([title[:i] + title[i + 1] + title[i] + title[i + 2 :], title[:i] + title[i + 1 :], title[:i] + title[i] + title[i:], title[:i] + "q" + title[i + 1 :]])
    return title


def releases(n=240, seed=2):
    """Rows (id, name, address, batch) with the release of each."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    made, rows, of = [], [], {}
    for i in range(n):
        batch = 0 if i < n // 2 else 1 + (i - n // 2) * 4 // (n // 2)
        if batch and rng.random() < 0.5 and made:
            k = 0 if rng.random() < 0.4 else rng.randrange(len(made))  # one release holds a large part
            title, episode, address = made[k]
            name = f"[Grp] {slip(title, rng) if rng.random() < 0.5 else title} - {episode:02d} [1080p][HEVC]"
            pick = rng.random()
            rows.append((i, None if pick < 0.2 else name, address.upper().replace("HTTPS", "https") if pick < 0.6 else f"https://z/t/{i:040x}.torrent" if pick < 0.8 else None, batch))
        else:
            k = len(made)
            made.append((f"{word()} {word()} of {word()}", k % 20, f"https://a/t/{i + 10**6:040x}.torrent"))
            rows.append((i, f"{made[k][0]}.S01E{k % 20:02d}.1080p.x265-Grp".replace(" ", "."), made[k][2], batch))
        of[i] = k
    return rows, of


SCHEMA = "id long, torrent_name string, torrent_url string, batch_no int"


def test_repeats(spark):
    rows, of = releases()
    first = {}
    for i, *_ in rows:
        first.setdefault(of[i], i)
    want = {(first[k], i) for i, k in of.items() if first[k] != i}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit("clash")).withColumn("first", F.lit(0))
    got = [(r.id_first, r.id_again) for r in R.repeats(df, "torrent_url", "torrent_name", "batch_no").collect()]
    assert len(got) == len(set(got)) and len(want - set(got)) <= 0.02 * len(want) and not set(got) - want


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.repeats(empty, "torrent_url", "torrent_name", "batch_no").count() == 0
    blank = spark.createDataFrame([(1, None, None, 0), (2, " ", "", 1), (3, None, None, 1), (4, "odd", None, 1), (5, "ODD ", None, 2), (6, None, "u", None)], SCHEMA)
    assert [tuple(r) for r in R.repeats(blank, "torrent_url", "torrent_name", "batch_no").collect()] == [(4, 5)]


def test_chains_inside_a_batch(spark):
    """1-2 share an address, 2-3 a name, 3-4 an address; all are one release."""
    u = lambda k: f"https://a/t/{k:040x}.torrent"
    n = lambda t: f"[G] {t} - 01 [720p][AVC]"
    rows = [(0, n("zzz yyy xxx"), u(0), 0), (1, n("abc def ghi"), u(1), 1), (2, n("mno pqr stu"), u(1), 1), (3, n("mno pqr stu"), u(2), 1), (4, None, u(2), 1), (5, n("mno pqr stt"), None, 2)]
    got = sorted(tuple(r) for r in R.repeats(spark.createDataFrame(rows, SCHEMA), "torrent_url", "torrent_name", "batch_no").collect())
    assert got[:3] == [(1, 2), (1, 3), (1, 4)] and all(g[0] == 1 for g in got)


def test_slips_of_a_later_name(spark):
    """A release is found by a slip of any of its names, not only of the one it began with; names of other attributes don't count."""
    u = lambda k: f"https://a/t/{k:040x}.torrent"
    n = lambda t, e=1: f"[G] {t} - {e:02d} [720p][AVC]"
    long = "alpha beta gamma delta epsilon"
    rows = [
        (0, n("zzz yyy xxx"), u(0), 0), (1, n("abc def ghi"), u(1), 1), (2, n("mno pqr stu"), u(1), 1), (3, n("mno pqr stu"), u(2), 1), (4, None, u(2), 1), (5, n("mno pqr stt"), None, 2),
        (6, None, u(6), 1), (7, n("quick brown foxes"), u(6), 2), (8, n("quick brown foxess"), None, 3), (9, n("zzz other words here"), u(0), 1), (10, n("zzz other words hree"), None, 4),
        (11, n(long), u(11), 1), (12, n(long + " and then the rest", 2), u(11), 2), (13, n(long + "s", 2), None, 3), (14, n(long + "s"), None, 4),
    ]
    got = sorted(tuple(r) for r in R.repeats(spark.createDataFrame(rows, SCHEMA), "torrent_url", "torrent_name", "batch_no").collect())
    assert got == [(0, 9), (0, 10), (1, 2), (1, 3), (1, 4), (1, 5), (6, 7), (6, 8), (11, 12), (11, 14)]


def test_index_is_reopened(spark):
    """One batch now, the next in another session, from the folder alone."""
    rows, _ = releases(n=60)
    df = spark.createDataFrame([r for r in rows if r[3] < 3], SCHEMA)
    whole = {tuple(r) for r in R.repeats(df, "torrent_url", "torrent_name", "batch_no").collect()}
    path = scratch_path(spark, "index-test")
    early = {tuple(r) for r in R.repeats(df.filter("batch_no < 2"), "torrent_url", "torrent_name", "batch_no", path=path).collect()}
    other = spark.newSession()
    index = R.ReleaseIndex.open(other, path)
    late = {tuple(r) for r in index.add(other.createDataFrame([r for r in rows if r[3] == 2], SCHEMA), "torrent_url", "torrent_name").collect()}
    index.destroy()
    assert early | late == whole and late


def test_releases_that_turn_out_to_be_one(spark):
    """3 has the address of 1 and the name of 2, so both are one release from then on."""
    u = lambda k: f"https://a/t/{k:040x}.torrent"
    n = lambda t: f"[G] {t} - 01 [720p][AVC]"
    rows = [(1, n("abc def ghi"), u(1), 0), (2, n("mno pqr stu"), u(2), 0), (3, n("mno pqr stu"), u(1), 1), (4, None, u(2), 2), (5, n("mno pqr sttu"), None, 3), (6, n("abc def ghi"), u(9), 4), (7, None, u(9), 5)]
    got = sorted(tuple(r) for r in R.repeats(spark.createDataFrame(rows, SCHEMA), "torrent_url", "torrent_name", "batch_no").collect())
    assert got == [(1, 3), (1, 4), (1, 5), (1, 6), (1, 7)]


def test_unreadable_names_match_nearly(spark):
    """Names without episode and quality: their numbers must agree, the rest may slip."""
    rows = [(1, "Complete collection of strange tales, disc 2", None, 0), (2, "Complete colection of strange tales, disc 2", None, 1), (3, "Complete collection of strange tales, disc 3", None, 1)]
    got = [tuple(r) for r in R.repeats(spark.createDataFrame(rows, SCHEMA), "torrent_url", "torrent_name", "batch_no").collect()]
    assert got == [(1, 2)]


def test_links_in_crowded_buckets(spark):
    """2 is like 1 and 3, which are too far apart; 1 represents the bucket. 4 is like none."""
    titles = {1: "a" * 20, 2: "a" * 16 + "b" * 4, 3: "a" * 12 + "b" * 8, 4: "c" * 20}
    names = spark.createDataFrame(list(titles.items()), "rep long, title string")
    with Scratch(spark) as scratch:
        index = R.ReleaseIndex(spark, scratch_path(spark, "crowded-test"), 4)
        links = index._crowded(names.select(F.lit(7).cast("long").alias("h"), F.col("rep").alias("a")), names, scratch)
        assert {frozenset((r.a, r.b)) for r in links.collect()} == {frozenset((1, 2)), frozenset((2, 3))}


def test_many_slips_of_one_name_in_a_batch(spark, monkeypatch):
    monkeypatch.setattr(R, "NEIGHBOURS", 5)
    title = "wandering lanterns of the northern quarry"
    rows = [(i, f"[G] {title[:i] + title[i + 1 :]} - 01 [720p][AVC]", None, 1) for i in range(1, 40) if " " not in title[i - 1 : i + 2]]
    got = {r.id_again for r in R.repeats(spark.createDataFrame(rows, SCHEMA), "torrent_url", "torrent_name", "batch_no").collect()}
    assert len(rows) > 20 and got == {r[0] for r in rows[1:]}


def test_many_names_of_equal_attributes_in_a_batch(spark, monkeypatch):
    """More than are compared at once: through their bands, and where these are crowded, by representatives."""
    monkeypatch.setattr(R, "PEERS", 5)
    monkeypatch.setattr(R, "NEIGHBOURS", 3)
    title = "wandering lanterns of the northern quarry"
    rows = [(i, f"[G] {title[:i] + title[i + 1 :]} - 01 [720p][AVC]", None, 1) for i in range(1, 40) if " " not in title[i - 1 : i + 2]]
    rows += [(100 + i, f"[G] {t} - 01 [720p][AVC]", None, 1) for i, t in enumerate(["quiet harbour of glass", "quite harbour of glass", "seven unlike copper keys"])]
    got = {(r.id_first, r.id_again) for r in R.repeats(spark.createDataFrame(rows, SCHEMA), "torrent_url", "torrent_name", "batch_no").collect()}
    assert got == {(rows[0][0], r[0]) for r in rows[1:-3]} | {(100, 101)}


def test_readable_names_are_held_once_and_compared_with_all_of_their_attributes(spark):
    """One row a name, and every slip is found, also at the limit of similarity (bands missed some of these)."""
    rng = random.Random(5)
    titles = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(15)) for _ in range(300)]
    far = []
    for t in titles:
        t, places = list(t), rng.sample(range(30), 6)
        for i in places:
            t[i] = "x"
        far.append("".join(t))
    name = "[G] {} - {:02d} [720p][AVC]".format
    old = [(i, name(t, i % 30), None, 0) for i, t in enumerate(titles)] + [(600, "Complete collection of strange tales, disc 2", None, 0)]
    new = [(300 + i, name(t, i % 30), None, 1) for i, t in enumerate(far)]
    index = R.ReleaseIndex(spark, scratch_path(spark, "held-once-test"), 4)
    index.accept(spark.createDataFrame(old, SCHEMA), "torrent_url", "torrent_name")
    assert index.store.tables("banded")[0].count() == 300 + index.bands
    got = {tuple(r) for r in index.add(spark.createDataFrame(new, SCHEMA), "torrent_url", "torrent_name").collect()}
    index.destroy()
    assert got == {(i, 300 + i) for i in range(300)}


def edited(text, count, rng):
    for _ in range(count):
        i, c = rng.randrange(len(text)), rng.choice("abcdefghijklmnopqrstuvwxyz")
        text = rng.choice([text[:i] + c + text[i + 1 :], text[:i] + c + text[i:], text[:i] + text[i + 1 :]])
    return text


@pytest.mark.parametrize(("letters", "edits"), [(n, k) for n in (6, 10, 15, 20, 30, 40) for k in sorted({1, n // 10, n // 5}) if k])
def test_band_keys_recall(letters, edits):
    """At least 0.9 of the pairs that are similar share a band key, whatever the length and the number of edits, and no
    signature rules a similar pair out."""
    rng = random.Random(letters * 100 + edits)
    titles = [("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(20)))[:letters] for _ in range(400)]
    pairs = [(a, b) for a in titles if (b := edited(a, edits, rng)) != a]
    a, b = (R.band_keys(list(x), np.zeros(len(pairs), np.int64), 8, 2) for x in zip(*pairs))
    assert (a[0] == b[0]).any(1).mean() >= 0.9
    assert max(bin(int(x) & (2**64 - 1)).count("1") + bin(int(y) & (2**64 - 1)).count("1") for x, y in a[1] ^ b[1]) <= 4 * edits
    c = R.band_keys([p[0] for p in pairs], np.ones(len(pairs), np.int64), 8, 2)
    assert not (a[0] == c[0]).any() and (a[1] == c[1]).all()


# --- packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=8), st.integers(0, 60))
def test_fullest_equals_enumeration(sizes, room):
    counts = {n: sizes.count(n) for n in set(sizes)}
    got = P.fullest(counts, sorted(counts, reverse=True), room)
    sums = [sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k)]
    assert sum(got) == max(s for s in sums if s <= room)
    assert all(got.count(n) <= counts[n] for n in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 95), min_size=1, max_size=60), st.integers(1, 40))
def test_bins_hold_every_item_once(sizes, capacity):
    bins = P.minimum_bin_slack(sizes, capacity)
    assert all(sum(n for *_, n in b) <= capacity for b in bins)
    pieces = {}
    for i, start, n in itertools.chain(*bins):
        pieces.setdefault(i, []).append((start, n))
    assert sorted(pieces) == list(range(len(sizes)))
    for i, parts in pieces.items():
        parts.sort()
        assert sum(n for _, n in parts) == sizes[i] and (len(parts) == 1 or sizes[i] > capacity)
        assert [s for s, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]


def test_packing_tables(spark):
    rows = [(i, n) for i, n in enumerate([700, 300, 512, None, 0, 5, 5, 202, 1500])]
    sizes = spark.createDataFrame([("s", 512), ("none", None), ("zero", 0)], "container string, capacity int")
    packed = P.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), sizes, shard_size=1000).collect()
    assert sum(r.tokens for r in packed) == sum(n or 0 for _, n in rows) and {r.doc_id for r in packed if r.bin is None} == {3, 4}
    assert P.pack(spark.createDataFrame([], "doc_id long, tokens long"), sizes).count() == 0
    assert P.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), sizes.limit(0)).count() == 0


def test_packing_is_nearly_full(spark, sf):
    for r in Q.p7_fill(spark, sf).collect():
        assert r.fullest <= r.capacity and r.bins <= r.least_bins + 1


def test_token_counts_round_trip(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    codec = T.encoding(T.VOCABULARY)
    for t in texts:
        if t:
            assert codec.decode(codec.encode_ordinary(t)) == t
    counted = T.with_tokens(spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string"), "doc_id", "text", []).collect()
    assert {r.doc_id: r.tokens for r in counted} == {1: 0, 2: 0, 3: 2}


# --- mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=60), st.floats(0.05, 0.95), st.integers(0, 9))
def test_flight_keeps_both_totals(sizes, p, seed):
    s, start = np.array(sizes, float), np.full(len(sizes), p)
    moved = X.flight(start, s, np.random.default_rng(seed))
    assert abs(moved.sum() - start.sum()) < 1e-6 and abs((moved * s).sum() - (start * s).sum()) < 1e-4
    assert ((moved > 0) & (moved < 1)).sum() <= 2 and moved.min() >= 0 and moved.max() <= 1


def test_settle_is_near_and_unbiased():
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(5, 400, 300), [20_000, 9_000]]).astype(float)
    p = np.full(len(sizes), 0.4)
    results = [X.settle(p, sizes, np.random.default_rng(k)) for k in range(200)]
    assert all(set(np.unique(r)) <= {0.0, 1.0} for r in results)
    assert max(abs((r * sizes).sum() - 0.4 * sizes.sum()) for r in results) < 60
    assert abs(np.mean([r[-2] for r in results]) - 0.4) < 0.12


def test_mixing_tables(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "a ", "b", "b", "b", "b", "c", None]), rng.choice([0, 5, 50, 500])) for i in range(900)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("B", 0.4, 1), ("missing", 0.05, 3), ("c", 0.05, None)], "source string, target_share double, max_repeats int")
    mixed = X.mix(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), targets, group=50)
    out = mixed.collect()
    assert len(out) == len(rows) and all(r.times_used == 0 for r in out if r.tokens == 0 or r.source in (None, "c"))
    used = {s: sum(r.tokens * r.times_used for r in out if r.source == s) for s in "ab"}
    assert abs(used["a"] / (used["a"] + used["b"]) - 5 / 9) < 0.01
    assert max(r.times_used for r in out if r.source == "a") <= 2 and max(r.times_used for r in out if r.source == "b") <= 1
    got = {r.source: r for r in X.shares(mixed, targets).collect()}
    assert got["missing"].tokens == 0 and abs(got["a"].actual_share - 5 / 9) < 0.01
    assert X.mix(spark.createDataFrame([], "doc_id long, source string, tokens long"), targets).count() == 0
    assert all(r.times_used == 0 for r in X.mix(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), targets.limit(0)).collect())


def test_shares_reached(spark, sf):
    """On a hundred documents one record can be some hundredths of the total."""
    for r in Q.p8_shares(spark, sf).collect():
        assert abs(r.actual_share - r.target_share) < 0.05 and r.most <= r.max_repeats


# --- garbled text


CLEAN = {
    "de": "Über dem Rücken lag eine Schicht – Größe {n} m², „gut“. Näheres später, schön für Änderungen.",
    "fr": "L’épisode {n} a été ignoré : déjà enregistré, à côté du relevé. « Où ça ? » Après avoir modifié.",
    "ru": "Правило {n} исключает названия, которые кончаются на восемь. Работа остановилась, панель сохраняет начало строки.",
    "zh": "气温{n}℃，露点低，风速不到每秒五米。列表保存为一行文本，寄存器显示为灰色。",
    "ja": "計算機は{n}で止まったが、手前の部分は使える。一覧を読み直すと戻る分岐が見つかった。",
    "en": "It’s not clear why row {n} – the first – didn’t change; “half” is ½ and 5 °C ± 1.",
}


def corpus(n, seed):
    rng = random.Random(seed)
    return [" ".join(CLEAN[lang].format(n=rng.randrange(9999)) for _ in range(rng.randrange(1, 4))) for lang in (rng.choice(list(CLEAN)) for _ in range(n))]


CASES = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "gbk"), ("cp1251", "cp1252"), ("gbk", "cp1252"), ("utf-8*2", "cp1252"), ("koi8-r", "cp1251")]


@pytest.fixture(scope="module")
def model():
    return G.fit(corpus(500, 1))


def found(model, text):
    places, keys = G.observed(text)
    return G.confirmed(model, text, G.spans(text, places, model.label([keys])[0]))


def test_held_out_accuracy(model):
    rng = random.Random(9)
    clean = corpus(150, 2)
    wrong = sum(bool(found(model, t)) for t in clean)
    hits = restored = total = 0
    for truth, read in CASES:
        for t in corpus(40, 3):
            odd = "".join(c for c in t if c > "\x7f")
            if G.misread(t, odd, truth, read, False) is None:
                continue
            kept = corpus(1, rng.randrange(999))[0]
            bad = kept + "\n" + G.garble(t, truth, read, False)
            spans = found(model, bad)
            total += 1
            hits += bool(spans)
            restored += G.restore(bad, spans)[0] == kept + "\n" + t if spans else 0
    assert wrong <= 2 and hits >= 0.97 * total and restored >= 0.75 * total and total > 60


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([p for p in G.PAIRS if p[1] not in ("utf-8", "ascii", "cp932", "gbk", "big5", "euc-kr")]), st.sampled_from(sorted(CLEAN)))
def test_inverse_is_exact(pair, lang):
    text = CLEAN[lang]
    code = pair[0].removesuffix("*2")
    if text.encode(code, "ignore").decode(code) != text:
        return
    assert G.ungarble(G.garble(text, *pair, strict=False), *pair) == (text, True)


def test_batched_viterbi_equals_single(model):
    docs = [G.observed(t)[1] for t in [*corpus(20, 5), "", "a", G.garble(CLEAN["de"] * 30, "utf-8", "cp1252", False)]]
    together = model.label(docs, together=7)
    for d, path in zip(docs, together):
        assert (model.label([d])[0] == path).all() and len(path) == len(d)


def test_garbled_table(spark):
    texts = corpus(300, 6) + [None, "", "plain", "x" * 200_000, "lost � and � again", G.garble(CLEAN["fr"], "utf-8", "cp1252", False)] * 2
    df = spark.createDataFrame([(i, t, "clash", dt.date(2024, 1, 1)) for i, t in enumerate(texts)], "doc_id long, text string, restored string, pairs date")
    got = {r.doc_id: r for r in G.find_garbled(df).collect()}
    assert set(got) == {304, 305, 310, 311}
    assert got[305].restored == CLEAN["fr"] == got[311].restored and got[305].whole and not got[304].whole
    assert G.find_garbled(df.filter("doc_id < 0")).count() == 0


def test_all_documents_are_counted(spark):
    """One document in 3,000 holds a character of its own; wherever it stands, the model has seen it."""
    texts = [f"Zeile {i} für {i}" for i in range(3000)]
    for k, c in enumerate("ѪѬѮѰ"):
        texts[k * 997] += f" a{c}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = G.train(df)
    assert {ord(c) for c in "ѪѬѮѰ"} <= set(model.char_keys.tolist())
    counted = G.tallies(texts, list(range(3000)))[0]
    assert counted[1].sum() == 3004


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["é", "ß", "ж", "気", "。", "a", "Z ", "plain text ", "\n", "~|", "µ"]), max_size=25), st.sampled_from(G.PAIRS), st.booleans())
def test_shortened_texts_count_the_same(parts, pair, strict):
    text = "".join(parts)
    short = G.shortened(text)
    assert G.observed(short)[1].tolist() == G.observed(text)[1].tolist()
    assert G.observed(G.garble(short, *pair, strict))[1].tolist() == G.observed(G.garble(text, *pair, strict))[1].tolist()


def test_documents_said_to_be_clean_are(model):
    docs = [G.observed(t)[1] for t in [*corpus(60, 11), *(G.garble(t, "utf-8", "cp1252", False) for t in corpus(60, 12))]]
    sure = model.surely_clean(docs)
    out = [None] * len(docs)
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    model._label(docs, order, out)
    assert not any(out[i].any() for i in np.flatnonzero(sure)) and 0 < sure.sum() < len(docs)


# --- the queries on the test tables


def test_queries_with_sql(spark, sf):
    from compare import differences, tables

    con = tables(sf)
    for name, sql in Q.ORACLES.items():
        assert differences(spark, con, Q.QUERIES[name], sql, sf) is None


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES) - {"p7_fill", "p8_shares"}))
def test_queries_run(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_a_model_is_saved_and_loaded(spark):
    model = G.fit(["Übergrößenträger für Äpfel", "façade déjà vu", "naïve coöperation", "São João é aqui"] * 3)
    path = scratch_path(spark, "model.json")
    G.save_model(spark, model, path)
    again = G.load_model(spark, path)
    keys = np.array([(1 << G.SHIFT) | 0xE9, 0xE9, 0x1F600])
    assert (model.emissions(keys) == again.emissions(keys)).all() and again.enter == model.enter
