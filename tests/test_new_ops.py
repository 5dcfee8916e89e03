"""Operators for views, containers, references and series in cells, against small cases worked out by hand."""

import struct

from pyspark.sql import functions as F

from gleanery.operators import arithmetic as A, byte_views as B, feeds, joins as J, layouts as L, malformed, ordered_lists as O, references as R, sampling, sensors, snapshots as V
from gleanery.streaming import polling


def test_callers_of_any_depth(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(0, 40)], "src long, dst long")
    found = R.callers(spark.createDataFrame([(0,)], "root long"), edges).collect()
    assert len(found) == 41 and max(r.depth for r in found) == 40
    assert R.callers(spark.createDataFrame([(0,)], "root long"), edges, depth=3).count() == 4


def test_keys_and_pages(spark):
    def keys(start, *pressed):
        return spark.createDataFrame([(start, list(pressed))], "s int, k array<string>").select(B.after_keys(F.col("k"), F.col("s"))).first()[0]

    assert keys(0, "up", "page_up", "down") == 1 and keys(9, "page_up") == 9 and keys(10, "page_up", "page_down") == 10
    assert keys(3, "17", "x", "") == 17 and keys(3, "99999999999") == 3 and keys(5) == 5
    data = b"\0" * 70 + b"needle" + b"\0" * 100 + b"needle"
    at = lambda line, height: spark.createDataFrame([(bytearray(data),)], "c binary").select(B.search_line(F.col("c"), F.lit(b"needle"), line, height)).first()[0]
    assert at(0, 2) == 4 and at(0, 5) == 11 and at(7, 5) == 7


def test_dumps(spark):
    rows = B.dump_rows(spark.createDataFrame([(1, bytearray(b"A1 -\xe9\xd7" + b"z" * 11)), (2, None)], "k int, c binary"), "k", "c").orderBy("row_no").collect()
    assert rows[0].line == "41 31 20 2d e9 d7 " + "7a " * 10 + "A1  é " + "z" * 10 and rows[1].line == "7a ".ljust(48) + "z"


def container(magic, start, stride, names, base, relative, by_count):
    size = start + stride * len(names)
    body, entries = b"", b""
    for name in names:
        at = (0 if relative else base) + size + len(body)
        entries += (name.ljust(32, b"\0") + struct.pack("<III", at, 4, 7)).ljust(stride, b"\0")
        body += (name * 4)[:4]
    return struct.pack("<IIII", magic, 0, size, len(names) if by_count else 0).ljust(start, b"\0") + entries + body


def test_containers_one_after_the_other(spark):
    first = container(0x484B5753, 64, 44, [b"a", b"bb"], 0, False, False)
    head = struct.pack("<IIII", 0x484B3230, 1, 32, 0).ljust(32, b"\1")
    third = container(0x484B3330, 240, 64, [b"c"], 0, True, True)
    files = spark.createDataFrame([("f", bytearray(first + head + third + b"tail of something")), ("g", bytearray(b"short")), ("h", None)], "f string, c binary")
    got = L.dispatched(files, "f", "c")
    assert [(r.variant, r.header_at, r.name) for r in got.orderBy("header_at", "idx").collect()] == [("KWS", 0, "a"), ("KWS", 0, "bb"), ("K30", len(first) + 32, "c")]
    assert {r.name: bytes(r.payload) for r in L.payloads(files, got, "f", "c").collect()} == {"a": b"aaaa", "bb": b"bbbb", "c": b"cccc"}
    assert L.dispatched(files.filter("f = 'g'"), "f", "c").count() == 0


def test_series_in_cells(spark):
    rows = [(u, k, (k * 7) % 4) for u in ("a", "b", None) for k in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "u string, k long, v long")
    for one, other in (
        (V.with_previous(df, "u", "k", "v"), V.with_previous(df, "u", "k", "v", 10)),
        (V.gaps(df, "u", "k", "k", "k"), V.gaps(df, "u", "k", "k", "k", 10)),
        (V.block_numbers(df, "u", "k", F.col("v") == 1), V.block_numbers(df, "u", "k", F.col("v") == 1, 10)),
        (O.only_changed(df, "u", "k", "v"), O.only_changed(df, "u", "k", "v", 10)),
    ):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_references_that_are_read(spark):
    memory = spark.createDataFrame([(10, 20, bytearray(b"\x14" + b"\0" * 7)), (20, 99, bytearray(b"textdata")), (30, 77, bytearray(b"\xff" * 8))], "a long, b long, c binary")
    chased = V.chase(spark.createDataFrame([("r", 10), ("s", 30), ("t", 5)], "k string, a long"), memory, "k", "a", "a", "b")
    kinds = {(r.k, r.depth): r.kind for r in V.readable(chased, memory, "k", "a", "c").collect()}
    assert kinds == {("r", 0): "addr", ("r", 1): "addr", ("r", 2): "data", ("s", 0): "addr", ("s", 1): "data", ("t", 0): "data"}
    regs = spark.createDataFrame([(1, "rip", 1), (2, "rip", 10), (1, "rax", 5), (2, "rax", 10)], "t int, reg string, v long")
    found = V.changed_references(regs, memory, "reg", "t", "v", "a", "b").orderBy("depth").collect()
    assert [(r.reg, r.t, r.address) for r in found] == [("rax", 2, 10), ("rax", 2, 20), ("rax", 2, 99)]
    assert V.any_known(memory).first().known and not V.any_known(memory.limit(0)).first().known


def test_rules_that_cannot_be_read(spark):
    entries = spark.createDataFrame([(1, "good", "abc"), (2, "good", "xyz"), (3, "bad", "abc"), (4, "none", None)], "id int, f string, t string")
    rules = spark.createDataFrame([("good", "^a"), ("bad", "("), ("none", None)], "f string, r string")
    got = {r.id: (r.chosen, r.error is not None) for r in feeds.judged_entries(entries, "t", rules, "f", "r").collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True), 4: (True, False)}


def test_lists_frames_and_cards(spark):
    shown = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "k string, p int")
    wanted = spark.createDataFrame([("c", 0), ("b", 1), ("d", 2)], "k string, p int")
    assert {r.k: (r.action, r.p) for r in O.synchronised(shown, wanted, "k", "p").collect()} == {"a": ("remove", None), "b": ("keep", 1), "c": ("move", 0), "d": ("add", 2)}
    frames = spark.createDataFrame([("f", 2, "y"), ("f", 1, "x"), ("g", 1, None)], "f string, o int, x string")
    assert [(r.f, r.frames) for r in sampling.collected(frames, "f", "o", "x").collect()] == [("f", ["x", "y"])]
    cards = spark.createDataFrame([("p", "cpu", "k10", 40, 1), ("p", "hard_disk", "sda", 30, 2), ("q", "fan", "z", 1, 1)], "g string, kind string, n string, v int, o int")
    html = {r.g: r.html for r in sensors.cards(cards, "g", "kind", "n", "v", "o").collect()}
    assert html == {"p": '<div class="card"><p>CPU k10 temperature: 40°C</p><p>Disk sda temperature: 30°C</p></div>', "q": '<div class="card"></div>'}


def test_templates_are_lexed(spark):
    for bad, reason in (("a$+b", "UnknownChar"), ("a\t+b", "UnknownChar"), ("2147483648", "NumberFormatError"), ("(a", "MissingBracket")):
        try:
            A.compile_expression(bad)
        except A.Failure as e:
            assert str(e) == reason
        else:
            raise AssertionError(bad)
    df = spark.createDataFrame([(2147483647, 2)], "a int, b int")
    both = df.select(A.compile_expression("a+b").alias("x"), A.compile_expression("a*b", wrap=False).alias("y"), A.compile_expression("-(a+b)").alias("z")).first()
    assert tuple(both) == (-2147483647, None, 2147483647)


def test_late_rows_and_errors(spark, tmp_path):
    listener = polling.PollErrors()
    spark.streams.addListener(listener)
    spark.range(3).selectExpr("id", "'n' AS torrent_name", "concat('u', id) AS torrent_url").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, torrent_name string, torrent_url string").parquet(str(tmp_path / "in"))

    def fail(rows):
        raise ValueError("no delivery")

    try:
        polling.poll(stream, str(tmp_path / "record"), str(tmp_path / "c1"), "id", fail).awaitTermination()
    except Exception:
        pass
    polling.poll(stream, str(tmp_path / "record"), str(tmp_path / "c2"), "id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "record")).count() == 3
    for _ in range(50):
        if listener.errors:
            break
        __import__("time").sleep(0.1)
    spark.streams.removeListener(listener)
    assert any("no delivery" in e for e in listener.errors)


def test_numbers_by_ranges(spark):
    df = spark.createDataFrame([(f"s{k:03d}",) for k in range(100)], "s string")
    got = J.numbered(df, "s", "n").orderBy("s").collect()
    assert [r.n for r in got] == list(range(1, 101))


def test_chunks_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(malformed, "SPAN", 3)
    text = "".join(f'{k},"a ""b""\nc",{k}\n' for k in range(40)).encode()
    chunks = spark.createDataFrame([("f", n, bytearray(text[n * 7 : n * 7 + 7])) for n in range(-(-len(text) // 7))], "path string, chunk_no long, content binary")
    rows = malformed.split_chunks(chunks).orderBy("record_at").collect()
    assert [r.fields for r in rows] == [[str(k), 'a "b"\nc', str(k)] for k in range(40)]


def test_long_ranges_are_few_cells(spark):
    ranges = spark.createDataFrame([(0, 2**47), (5, 5), (2**50, 2**50 + 3), (9, 1)], "lo long, hi long")
    points = spark.createDataFrame([(0,), (2**47,), (2**47 + 1,), (2**50 + 3,), (2**50 + 4,), (None,)], "v long")
    assert sorted(r.v for r in J.in_ranges(points, ranges, "v", "lo", "hi", 1 << 20).collect()) == [0, 2**47, 2**50 + 3]
    assert {r.v for r in J.in_ranges(points, ranges, "v", "lo", "hi", 1 << 20, keep=False).collect()} == {2**47 + 1, 2**50 + 4, None}


def test_segments_list_their_sections_without_a_join(spark, sf):
    from gleanery.plans import reference_queries as Q

    plan = Q.executable_segments(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("MapInPandas") == 1
    rows = [(k, bytearray(Q.executable(k))) for k in range(9)] + [(100, bytearray(b"\x7fELF")), (101, None)]
    parsed = L.executables(spark.createDataFrame(rows, "file long, c binary"), "file", "c")
    got = {(r.file, r.idx): r.sections for r in L.sections_in_segments(parsed, "file").collect()}
    part = lambda k, *at: [f".s{i}_{k % 7}" for i in at if i <= k % 4]
    assert got == {(k, s): part(k, 0, 1, 2) if s == 0 else part(k, 3) for k in range(9) for s in (0, 1)}


def test_unsigned_fields_of_all_sizes(spark):
    data = bytes([0xA1, 0xB2, 0xC3, 0x04, 0x50, 0x0F, 0xF0, 0x80, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0x00])
    df = spark.createDataFrame([(bytearray(data),), (bytearray(),), (None,)], "c binary")
    asked = [(at, size) for size in (1, 2, 4, 8) for at in range(0, 17)]
    rows = df.select(*(L.unsigned(F.col("c"), F.lit(at), size).alias(f"{at}_{size}") for at, size in asked)).collect()
    assert [None if x is None else int(x) for x in rows[0]] == [int.from_bytes(data[at : at + size], "little") if at + size <= 17 else None for at, size in asked]
    assert set(rows[1]) == set(rows[2]) == {None}


def test_xored_bytes_are_those_of_the_stream(spark):
    key = [7 * i + 3 for i in range(16)]
    values = [None, b"", b"\x00", bytes(range(256)) * 3 + b"end", "Größe".encode()]
    df = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, c binary")
    got = df.select("i", B.xored(F.col("c"), key).alias("x"), B.xor_stream(F.col("c"), key).alias("s"), B.xored(B.xored(F.col("c"), key), key).alias("again")).orderBy("i").collect()
    assert [r.x if r.x is None else list(r.x) for r in got] == [r.s for r in got]
    assert [r.again if r.again is None else bytes(r.again) for r in got] == values


def test_xor_texts_makes_no_array_per_byte(spark, sf):
    from gleanery.plans import reference_queries as Q

    plan = Q.xor_texts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "conv(" not in plan
