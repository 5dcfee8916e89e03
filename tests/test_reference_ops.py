"""Value-level goldens of the reference's operators."""

import json
import struct

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from gleanery.functions import patterns as P
from gleanery.operators import arithmetic as A, byte_views as B, control_flow as C, feeds, joins as J, layouts as L, ordered_lists as O, references as X, relocations as S, sampling as T, sensors as D, snapshots as V, weather_tokens as W
from gleanery.plans.reference_queries import small_executable
from gleanery.sources import readers


@pytest.mark.parametrize(
    ("text", "value", "error"),
    [
        ("(1+2)*3+4/2", 11, None), ("1+23 -4*( 567/8)", -256, None), ("1+2*3", 7, None), ("-1+2", 1, None), ("1+2*", None, "Unmatch"), ("--1+2", None, "Unmatch"), ("7/0", 0, None),
        ("1+2)", 3, None), ("1)2", 1, None), ("(1+2", None, "MissingBracket"), ("1 2", None, "Unmatch"), ("2*-3", -6, None), ("2147483648", None, "NumberFormatError"), ("1\t+2", None, "UnknownChar"),
        ("", None, "Unmatch"), ("-(1+2)", -3, None), ("((((2))))", 2, None), ("-7/2", -3, None), ("2147483647+1", -2147483648, None),
    ],
)
def test_arithmetic(text, value, error):
    try:
        assert A.compute(A.postfix(text)) == value and error is None
    except A.Failure as e:
        assert str(e) == error
    if text == "-(1+2)":
        assert A.compute(A.postfix(text, compat=True)) == 3


@given(st.recursive(st.integers(0, 99).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]}{t[1]}{t[2]})"), max_leaves=12))
def test_arithmetic_equals_direct(text):
    want = eval(text)  # noqa: S307  digits, brackets and operators only
    assert A.compute(A.postfix(text), wrap=False) in (want, None)


def test_compiled_and_evaluated_agree(spark):
    texts = ["(1+2)*3+4/2", "7/0", "2-9/4*3", "-(4+4)", "2147483647*2"]
    df = A.evaluate(spark.createDataFrame([(t,) for t in [*texts, None, "x"]], "t string"), "t", wrap=False)
    rows = df.collect()
    row = spark.range(1).select(*(A.compile_expression(t, wrap=False).alias(f"c{i}") for i, t in enumerate(texts))).first()
    assert [r.result.value for r in rows[:5]] == list(row) == [11, 0, -4, -8, None]
    wrapped = spark.range(1).select(*(A.compile_expression(t).alias(f"c{i}") for i, t in enumerate(texts))).first()
    assert list(wrapped) == [A.compute(A.postfix(t)) for t in texts] == [11, 0, -4, -8, -2]
    assert rows[5].result.value is None and rows[5].result.error is None and rows[6].result.error == "UnknownChar"


def test_patterns_never_give_back(spark):
    words = P.sequence("^", P.one_or_more(P.any_char("ab")), P.literal("b"), "$")
    twice = P.sequence("^", P.any_of("a", "ab"), P.literal("c"), "$")
    row = spark.range(1).select(F.lit("aab").rlike(words).alias("x"), F.lit("abc").rlike(twice).alias("y"), F.lit("a.c").rlike("^" + P.literal("a.c") + "$").alias("z"), F.lit("aaa").rlike("^" + P.exactly(2, "a") + "$").alias("n")).first()
    assert list(row) == [False, False, True, False]
    row = spark.range(1).select(P.flatten_once(F.array(F.array(F.lit("a")), F.array(F.lit("b")))).alias("f"), P.joined(P.mapped(F.array(F.lit("x"), F.lit("y")), F.upper)).alias("j")).first()
    assert row.f == ["a", "b"] and row.j == "XY"


REPORTS = [
    "METAR/SPECI QQAB 110905Z 31004MPS 0300 R17L/0400D FZFG BKN003 M05/M06 Q1031 BECMG TL1015 1200 BECMG AT1130 5000 BR=",
    "METAR QQCD 280215Z 07021G38KT 030V110 1500 R08R/0900 FZFG +TSRA SQ FEW020 BKN040CB 19/M03 Q0987 WS LDG RWY08L TEMPO 0800 +RA=",
    "ABCD 010203Z CAVOK XYZ 9999 ",
]


def test_weather_tokens(spark):
    df = spark.createDataFrame(list(enumerate(REPORTS)) + [(9, None), (10, "")], "line_id int, line string")
    tokens = W.weather_tokens(df).orderBy("line_id", "pos").collect()
    kinds = {i: [t.kind for t in tokens if t.line_id == i] for i in range(3)}
    assert kinds[0] == ["report", "icao", "time", "wind", "visibility", "runway", "icao", "cloud", "temperature", "pressure", "trend", "trend", "visibility", "trend", "trend", "visibility", "weather"]
    assert kinds[1][4:] == ["vary", "visibility", "runway", "icao", "weather", "weather", "cloud", "cloud", "temperature", "pressure", "shear", "trend", "visibility", "weather"]
    assert kinds[2] == ["icao", "time", "cavok"]
    by = {(t.line_id, t.pos): t for t in tokens}
    assert by[0, 6].kind_fixed == "weather" and by[0, 5].runway == ["R", "17L", "/", "0400D"] and by[1, 3].wind_gust == "38"
    assert by[1, 8].weather == ["+", "TS", "RA"] and by[1, 11].cloud_cb == "CB" and by[1, 14].shear == ["WS", "LDG", "RWY08L"]
    done = {r.line_id: (r.used, r.complete) for r in W.consumed(df).collect()}
    assert done[0] == (len(REPORTS[0]), True) and done[2] == (len("ABCD 010203Z CAVOK "), False) and done[10] == (0, True) and done[9][0] is None


def test_token_texts_are_the_prefix(spark, sf):
    lines = spark.read.parquet(f"{sf}/zspd.parquet").filter("line is not null")
    bad = lines.filter(~F.startswith(F.col("line"), F.array_join(W.token_array(F.col("line")), "")))
    assert bad.count() == 0


def test_loops_and_order():
    g = C.Graph([(3, 4), (3, 8), (4, 5), (5, 6), (6, 7), (6, 5), (7, 4)])
    found = C.loop_bodies(g, 3)
    assert found[5] == [6, 5] and found[4] == [7, 6, 5, 4] and not found[3]
    assert [sorted(p) for p in C.components_in_order(g)][0] == [3]


def test_regions():
    g = C.Graph([(0, 2), (0, 4), (2, 6), (4, 6), (6, 8), (6, 10), (8, 10), (10, C.EXIT)])
    found = C.branch_patterns(g)
    assert found == {6: ("if", 6, (8, None), 10), 0: ("if_else", 0, (2, 4), 6)}
    assert C.contract(g, found[6]) == ("if", [6], 8, None) and g.after[6] == [10]
    assert C.contract(g, found[0]) == ("if_else", [0], 2, 4)
    assert g.after[0] == [6] and C.branch_patterns(g) == {}
    many = C.Graph([(0, 2), (0, 6), (2, 4), (2, 6), (4, 8), (6, 8)])
    assert C.contract(many, C.branch_patterns(many)[2]) == ("if_many", [0, 2], 4, 6) and many.after == {0: [8], 8: []}


def test_kept_dead_end(spark):
    edges = [(0, 2), (0, 8), (2, 4), (2, 6), (4, 6), (6, 8), (8, C.EXIT)]
    df = spark.createDataFrame([("p", k, a, b) for k, (a, b) in enumerate(edges)], "prog_id string, edge_seq int, src int, dst int")
    assert [(r.kind, r.label) for r in C.regions(df).collect()] == [("if", 2)]
    graph = C.Graph(edges)
    C.contract(graph, C.branch_patterns(graph)[2], compat=True)
    assert graph.after[2] == [6, 4] and graph.after[4] == []


def test_flow_of_a_for_loop_and_statements(spark):
    text = "  1  0 RESUME  0\n  2  2 LOAD_FAST 0 (xs)\n  4 GET_ITER\n  6 FOR_ITER 5 (to 20)\n  8 STORE_FAST 0 (x)\n 10 LOAD_FAST 0 (x)\n 12 POP_TOP\n 14 JUMP_BACKWARD 5 (to 6)\n 20 LOAD_CONST 0 (None)\n 22 RETURN_VALUE\n\nnothing"
    lines = C.parse_listing(spark.createDataFrame([("p", text)], "prog_id string, text string"))
    edges = {(r.src, r.dst) for r in C.flow_edges(lines).collect()}
    assert edges == {(0, 6), (6, 20), (6, 6), (20, C.EXIT)}
    said = [r.statement for r in C.statements(lines).orderBy("label", "pos").collect()]
    assert said == ["xs", "x = ?", "return None  # goto "]

    def run(*steps):
        listed = spark.createDataFrame([("p", k, 2 * k, op, a) for k, (op, a) in enumerate(steps)], C.INSTRUCTION)
        return [r.statement for r in C.statements(listed).orderBy("pos").collect()]

    assert run(("LOAD_NAME", "f"), ("LOAD_NAME", "a"), ("LOAD_ATTR", "b"), ("CALL", ""), ("STORE_NAME", "r")) == ["r = f(a.b)"]
    assert run(("BINARY_OP", "+")) == ["? + ?"] and run(("CALL", None), ("NOP", "")) == ["?()"]
    assert run(("LOAD_FAST", "$1"), ("LOAD_CONST", "2"), ("BINARY_SUBSCR", ""), ("POP_JUMP_BACKWARD_IF_TRUE", "to 40")) == ["if $1[2]:\nbreak  # goto to 40"]
    cols = C.parse_columns(spark.createDataFrame([("p", "0  LOAD_FAST  0: (i)\n2  RETURN_VALUE\nx")], "prog_id string, text string")).orderBy("linenum").collect()
    assert [(r.linenum, r.op) for r in cols] == [(0, "LOAD_FAST"), (2, "RETURN_VALUE")]


def test_asof(spark):
    starts = spark.createDataFrame([(10,), (20,), (30,), (None,)], "s long")
    left = spark.createDataFrame([(9,), (10,), (25,), (99,), (None,)], "v long")
    for width in (1, 7, 1000):
        got = {r.v: r.found for r in J.asof(left, starts, "v", "s", "s", width=width, default=0).collect()}
        assert got == {9: 0, 10: 10, 25: 20, 99: 30, None: None}
    assert J.asof(left, starts.limit(0), "v", "s", "s", width=5, default=0).filter("v is not null").agg(F.max("found")).first()[0] == 0


def test_ranges(spark):
    ranges = spark.createDataFrame([(10, 20), (5, 4)], "start long, end long")
    points = spark.createDataFrame([(9,), (10,), (20,), (21,), (None,)], "v long")
    assert sorted(r.v for r in J.in_ranges(points, ranges, "v", "start", "end", 3).collect()) == [10, 20]
    assert J.in_ranges(points, ranges.limit(0), "v", "start", "end", 3).count() == 0
    inner = spark.createDataFrame([("a", 1, 2), ("b", 0, 0), ("c", 3, 9)], "k string, lo long, hi long")
    outer = spark.createDataFrame([("x", 0, 5), ("y", 7, 8)], "o string, l long, h long")
    got = {r.o: r.members for r in J.contained(inner, outer, "k", "o", "lo", "hi", "l", "h", 2.0).collect()}
    assert got == {"x": ["a", "b"], "y": []}


def test_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x00\x20\x21\x7e\x7f\x80\xfe\xff"))], "k int, c binary")
    classes = df.select(F.explode(B.byte_numbers(F.col("c"))).alias("b")).select(B.byte_class(F.col("b")).alias("x")).collect()
    assert [r.x for r in classes] == ["GREY", "GREEN", "BLUE", "BLUE", "GREEN", "YELLOW", "YELLOW", "GREEN"]
    assert {r["class"]: r["count"] for r in B.class_counts(df, "c").collect()} == {"GREY": 1, "BLUE": 2, "YELLOW": 2, "GREEN": 3}
    data = bytes(range(256)) * 3 + b"end"
    rows = B.hex_rows(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, None)], "k int, c binary"), "k", "c").orderBy("address").collect()
    assert bytes.fromhex("".join(r.hex.replace(" ", "") for r in rows)) == data and rows[2].address == "00000020" and rows[-1].chars == "end"
    for size in (1, 2, 5, 1000):
        pieces = [("f", i // size, bytearray(data[i : i + size])) for i in range(0, len(data), size)]
        chunks = spark.createDataFrame(pieces, "f string, n long, c binary")
        assert B.find_in_chunks(chunks, "f", "n", "c", b"\xff\x00\x01").first().offset == 255
        assert B.find_in_chunks(chunks, "f", "n", "c", b"zz").first().offset == -1
    s = spark.createDataFrame([(bytearray(b"x" * 40),), (bytearray(b"abc\0def"),)], "c binary").select(B.c_string(F.col("c"), F.lit(0)).alias("none"), F.length(B.c_string(F.col("c"), F.lit(1))).alias("n")).collect()
    assert [(r.none, r.n) for r in s] == [("", 33), ("", 2)]
    run = spark.createDataFrame([(bytearray(b"\0\0a\0"),), (bytearray(b""),)], "c binary").select(B.leading_run(F.col("c")).alias("n")).collect()
    assert [r.n for r in run] == [2, 0]


def test_executables_and_containers(spark):
    parsed = L.executables(spark.createDataFrame([("f", bytearray(small_executable())), ("short", bytearray(b"\x7fELF")), ("none", None)], "f string, c binary"), "f", "c")
    assert [r.name for r in L.sections(parsed, "f").filter("f = 'f'").orderBy("idx").collect()] == ["", ".text", ".data", ".names"]
    assert L.sections(parsed, "f").filter("f <> 'f'").count() == 0
    gap = L.segment_gaps(parsed, "f").collect()
    assert [(r.idx, int(r.gap)) for r in gap] == [(0, 0x3000 - 0x1200)]
    entry = lambda name, *x: name.ljust(32, b"\0") + struct.pack("<III", *x)
    body = struct.pack("<IIII", 7, 0, 64 + 2 * 44, 2) + b"\0" * 48 + entry(b"one", 152, 3, 9) + entry(b"two", 155, 2, 9) + b"abcde"
    files = spark.createDataFrame([("f", bytearray(body))], "f string, c binary")
    for by_size in (True, False):
        entries = L.containers(files, "f", "c", 64, 44, by_size)
        got = {r.name: bytes(r.payload) for r in L.payloads(files, entries, "f", "c").collect()}
        assert got == {"one": b"abc", "two": b"de"}
    big = spark.createDataFrame([(bytearray(b"\xff" * 8),)], "c binary").select(L.unsigned(F.col("c"), F.lit(0), 8).alias("x"), L.unsigned(F.col("c"), F.lit(0), 2).alias("y")).first()
    assert int(big.x) == 2**64 - 1 and big.y == 65535


def test_snapshots(spark):
    lines = ["7e00aa000000-7e00aa021000 r-xp 00004000 08:01 77   /opt/own", "7f00-7f10 rw-p 0000a000 fd:01 5 /x", "junk"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert V.parse_maps(df).count() == 2 and V.parse_maps(df, compat=True).count() == 1
    regs = spark.createDataFrame([(1, "rip", 1), (2, "rip", 2), (1, "rax", 5), (2, "rax", 6), (3, "rax", 6)], "t int, reg string, v long")
    assert [(r.reg, r.t, r.previous) for r in V.changed_items(regs, "reg", "t", "v").collect()] == [("rax", 2, 5)]
    memory = spark.createDataFrame([(10, 20), (20, 30), (30, 40), (40, 50)], "a long, b long")
    chased = V.chase(spark.createDataFrame([("r", 10)], "k string, a long"), memory, "k", "a", "a", "b")
    assert V.chain_text(chased, "k").first().chain == "0xa => 0x14 => 0x1e => 0x28"
    x = spark.range(1).select(V.unsigned_register(F.lit(-1)).cast("string").alias("x"), V.unsigned_register(F.lit(-1), True).cast("string").alias("y")).first()
    assert (x.x, x.y) == (str(2**64 - 1), "1")
    asm = spark.createDataFrame([(0, 4096, "call 5 <f+1>  # x"), (1, 4100, "ret")], "o int, a long, t string")
    got = [r.line for r in V.clean_listing(asm, "o", "a", "t").orderBy("row_no").collect()]
    assert got[0].startswith("=> ") and "<f" not in got[0] and got[1].endswith("0x1004 ret")
    names = spark.createDataFrame([("rdi", 0), ("rip", 1), ("eip", 2)], "r string, o int")
    assert V.instruction_pointer(names, "r", "o").first().r == "rip" and V.call_arguments(names, "r", "i386:x86-64").first().argument_no == 1


def test_references(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("b", "a")], "src string, dst string")
    got = {(r.node, r.depth) for r in X.callers(spark.createDataFrame([("a",)], "root string"), edges).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    calls = spark.createDataFrame([(1, "x", 5, "f"), (2, "x", 0, "g"), (3, "x", 9, "h"), (4, "y", None, "i")], "t int, target string, arg long, name string")
    good, bad = X.recovered_labels(calls, "target", "name", "t", {"argument": X.valid_address(F.col("arg"), F.lit(1), F.lit(100))})
    assert [tuple(r) for r in good.collect()] == [("x", "h")] and bad.count() == 2
    first, _ = X.recovered_labels(calls, "target", "name", "t", {}, last_wins=False)
    assert {tuple(r) for r in first.collect()} == {("x", "f"), ("y", "i")}


def test_lists(spark):
    base = F.array(*map(F.lit, "abcd"))
    moves = [("c", 1, "acbd"), ("c", 99, "abdc"), ("c", -5, "cabd"), ("z", 0, "abcd")]
    row = spark.range(1).select(*(O.moved(base, F.lit(x), F.lit(i)).alias(str(k)) for k, (x, i, _) in enumerate(moves))).first()
    assert ["".join(x) for x in row] == [m[2] for m in moves]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate("abcd")], "k string, pos long")
    for x, i, want in moves:
        assert "".join(r.k for r in O.moved_rows(rows, "k", "pos", x, i).orderBy("pos").collect()) == want
    assert "".join(r.k for r in O.appended(rows, "pos", spark.createDataFrame([("e", 0)], "k string, pos long")).orderBy("pos").collect()) == "abcde"
    note = spark.range(1).select(O.to_text(F.array(O.note(F.lit("todo"), F.lit("x"), F.lit("1")), O.note(F.lit("odd"), F.lit("y"), F.lit("2")), O.note(F.lit("header"), F.lit("z"), F.lit("3")))).alias("t"))
    data = json.loads(note.first().t)
    assert data[0]["checked"] is False and "checked" not in data[2]
    back = note.select(O.from_text(F.col("t")).alias("n"), O.from_text(F.col("t"), False).alias("m")).first()
    assert [n.content for n in back.n] == ["x", "z"] == [n.content for n in back.m]
    pos = spark.createDataFrame([(0, 5.0), (1, 15.0), (2, 25.0)], "p long, m double")
    assert [O.drop_index(pos, "p", "m", y).first()["index"] for y in (0, 10, 30)] == [0, 1, 3]
    commands = spark.createDataFrame([("todo",), ("title",)], "c string")
    assert O.matching_commands(commands, "c", "to").count() == 1 and O.matching_commands(commands, "c", "").count() == 0
    updates = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("a", 4, "x")], "k string, t int, v string")
    assert [r.t for r in O.only_changed(updates, "k", "t", "v").orderBy("t").collect()] == [1, 3]


def test_feed_rules(spark):
    df = spark.createDataFrame([(None,), ("0",), ("30",), ("x",)], "s string").select(feeds.on_air_range(F.col("s")).alias("d")).collect()
    assert [r.d for r in df] == [90, 90, 30, 90]
    days = spark.createDataFrame([("2024-01-01",), ("2023-12-31",), ("2025-01-01",), (None,)], "d string").select(feeds.on_air(F.col("d").cast("date"), F.lit("2024-03-31").cast("date"), F.lit(90)).alias("x")).collect()
    assert [r.x for r in days] == [True, False, True, False]
    entries = spark.createDataFrame([(1, "good raw", None), (2, "bad", "bad"), (3, "raw", ""), (4, None, None)], "i int, t string, own string")
    assert [r.i for r in feeds.select_entries(entries, "t", "own", exclude="^raw").orderBy("i").collect()] == [1, 4]
    assert [r.i for r in feeds.select_entries(entries, "t", "own", include="good").orderBy("i").collect()] == [1]
    rows = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 3, "c"), (None, 4, "d")], "url string, seq int, x string")
    assert {(r.url, r.x) for r in feeds.new_downloads(rows, rows.filter("url = 'v'"), "url", "seq").collect()} == {("u", "a")}
    urls = spark.createDataFrame([("quay://a",), ("other://quay://",), (None,)], "u string").select(feeds.expand_shortcuts(F.col("u"), [("quay", "https://q/$1/")]).alias("x")).collect()
    assert [r.x for r in urls] == ["https://q/$1/a", "other://quay://", None]
    call = spark.range(1).select(feeds.payload(F.lit("n"), F.lit(b"\x00" * 90), F.lit("/d"), F.lit(None).cast("string")).alias("p")).first().p
    assert json.loads(call)["id"] == 1 and len(json.loads(call)["params"]) == 3 and json.loads(call)["params"][2] == {"dir": "/d/n"}


def test_sensors_sampling_relocations(spark, tmp_path):
    smart = spark.createDataFrame([("sda", 1, "193 x"), ("sda", 3, "194 Temp 0x22 a b c d e - 41 (Min)"), ("sda", 2, "194  Temp 0x22 a b c d e - 40"), ("sdb", 1, "no")], "device string, line_no int, line string")
    assert {r.device: r.temperature for r in D.disk_temperature(smart).collect()} == {"sda": "40", "sdb": None}
    names = spark.createDataFrame([(n,) for n in ("sda", "sda1", "nvme0", "nvme0n1", "tty")], "n string")
    assert [r.n for r in names.filter(D.is_disk(F.col("n"))).collect()] == ["sda", "nvme0"]
    page = spark.range(1).select(D.fill_template(F.lit("http://{current}/ariang/{x}"), F.create_map(F.lit("current"), F.lit("1.1.1.1"))).alias("p")).first().p
    assert page == "http://1.1.1.1/ariang/{x}"
    assert round(T.rounded_interval(30), 1) == 33.3
    assert spark.range(1).select(T.ladder(F.lit(50)).alias("x")).first().x == [-50, -30, -10, 10, 30, 50]
    tags = spark.createDataFrame([("f", 0, "STRTAB", 1), ("f", 1, "STRTAB", 2), ("f", 2, "PLTRELSZ", 49)], "f string, idx int, tag string, value long")
    t = S.dynamic_tables(tags, "f").first()
    assert t.STRTAB == 2 and t.entries == 2 and t.error == "no STRSZ, no JMPREL, no SYMTAB"
    config = tmp_path / "c.toml"
    config.write_text('[var]\na="1"\n[[shortcuts]]\nname="q"\nalias="https://q/"\n[[subscribes]]\nname="s"\ntime=2024-01-02\nurl="q://x"\n')
    read = readers.configuration(config)
    s = readers.subscriptions(spark, read).first()
    assert s.url == "https://q/x" and s.on_air_range is None and readers.variables(spark, read).first().variables == {"a": "1"}
    feed = tmp_path / "feed.xml"
    feed.write_text('<feed><entry><id>e</id><link href="u" type="application/x-bittorrent"/><link href="w" type="text/html"/></entry></feed>')
    assert [r.href for r in feeds.links(readers.staged_feed(spark, str(feed)), "id").collect()] == ["u"]
    data = tmp_path / "blob"
    data.write_bytes(b"abcdefg")
    got = readers.binary_chunks(spark, str(data), 3).orderBy("chunk_no").collect()
    assert [bytes(r.content) for r in got] == [b"abc", b"def", b"g"]
    assert readers.binaries(spark, str(data)).first().length == 7
    out = tmp_path / "out"
    out.mkdir()
    readers.write_files(spark.createDataFrame([("x", bytearray(b"1"))], "n string, c binary"), "n", "c", str(out))
    assert (out / "x").read_bytes() == b"1"


def test_bytes_of_whole_documents(spark, sf):
    from gleanery.plans import reference_queries as Q

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = Q.QUERIES["hex_rows_texts"](spark, sf).collect()
    assert {(r.doc_id, int(r.address, 16)): bytes.fromhex(r.hex) for r in rows} == {(d, k): b[k : k + 16] for d, b in texts.items() for k in range(0, len(b), 16)}
    assert len(rows) == sum(-(-len(b) // 16) for b in texts.values()) > 1000
    got = {r.doc_id: bytes.fromhex(r.hex) for r in Q.QUERIES["xor_texts"](spark, sf).collect()}
    assert got == {d: bytes(x ^ Q.KEY[(i + (i >> 4)) & 15] for i, x in enumerate(b)) for d, b in texts.items()}
