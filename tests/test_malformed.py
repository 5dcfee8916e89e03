import csv

import numpy as np
from hypothesis import given, settings, strategies as st

from gleanery.operators import malformed as M


def sequential(data: bytes, delimiter=b",", quote=b'"', multiline=False):
    table, lut = M.transition_table(multiline), M.byte_classes(delimiter.decode(), quote.decode(), "\n" if multiline else None)
    state, out = M.NEW, []
    for b in data:
        out.append(state)
        state = int(table[lut[b], state])
    return [*out, state]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='ab,"\n', max_size=400), st.integers(1, 9))
def test_chunked_states_equal_a_sequential_run(text, chunk):
    data = text.encode()
    lut = M.byte_classes(",", '"', "\n")
    got = M.run_states(lut[np.frombuffer(data, np.uint8)], M.transition_table(True), chunk)
    assert got.tolist() == sequential(data, multiline=True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='aé,"', max_size=20), min_size=1, max_size=9))
def test_fields_equal_the_csv_module(fields):
    line = ",".join('"' + f.replace('"', '""') + '"' if '"' in f or "," in f else f for f in fields)
    got, at, why, _ = M.split_rows([line], ",", '"')[0]
    assert why is None and got == fields == next(csv.reader([line]), [""]) or line == ""
    assert len(at) == len(got)


def test_reasons_and_offsets():
    rows = M.split_rows(['a,"b', '"a"x,b', None, "", "é,b"], ",", '"')
    assert [r[2] for r in rows] == ["open quote", "text after a closing quote", "no line", None, None]
    assert rows[1][3] == 3 and rows[4][1] == [0, 3]


LINES = [
    ("plain", "QSSP 010002Z 22013MPS 6000 SCT139 07/02 Q1012 NOSIG", []),
    ("plain", "METAR QSSP 010002Z 22013MPS 160V190 CAVOK 07/02 Q1012", []),
    ("plain", "QSSP 010002Z 22013MPS 22013MPS 6000 SCT139 07/02 Q1012", ["WindExpr"]),
    ("plain", "QSSP 010002Z 37013MPS 6000 SCT13 07/02 Q1012", ["CloudExpr", "WindExpr"]),
    ("plain", "QSSP 010002Z", ["CloudExpr", "WindExpr"]),
    ("plain", "   ", ["line"]),
    ("plain", None, ["line"]),
    (None, "QSSP 010002Z VRB01KT 9999 -RA NSC=", []),
    ("csv", 'A,010002Z,22013MPS,6000,"SCT139,OVC001CB",07/02,Q1012,"x ""y"""', []),
    ("csv", "A,010002Z,22013MPS,CAVOK,,07/02,Q1012,", []),
    ("csv", "A,010002Z,22013MPS,6000,,07/02,Q1012,", ["CloudExpr"]),
    ("csv", "A;b", ["line"]),
    ("csv", 'A,b,"c', ["line"]),
]


def test_lines(spark):
    rows = [(i, layout, line, "clash") for i, (layout, line, _) in enumerate(LINES)] * 2
    df = spark.createDataFrame(rows, "line_id long, layout string, line string, failures string")
    found = M.failed_parts(M.load_report_lines(df), "line_id").collect()
    for i, (_, _, want) in enumerate(LINES):
        assert sorted(r.expr for r in found if r.line_id == i) == sorted(want * 2), LINES[i]
    assert M.load_report_lines(df.limit(0)).count() == 0
    good = {r.line_id: r for r in M.valid_lines(M.load_report_lines(df)).collect()}
    assert good[0].wind_expr.speed == "13" and good[8].cloud_expr[1].cb == "CB" and good[9].cloud_expr == []


def test_a_very_long_line(spark):
    line = "A,010002Z,22013MPS,6000,SCT139,07/02,Q1012," + '"' + "x,\"\"" * 200_000 + '"'
    df = spark.createDataFrame([(1, "csv", line)], "line_id long, layout string, line string")
    assert M.load_report_lines(df).first().failures == []


def test_chunks_across_tasks(spark):
    text = b'a,"b\nc",d\n"x""y",,z\nlast,"no end\n'
    for size in (1, 2, 3, 7, 100):
        pieces = [("f", k, bytearray(text[i : i + size])) for k, i in enumerate(range(0, len(text), size))]
        got = M.split_chunks(spark.createDataFrame(pieces, "path string, chunk_no long, content binary")).orderBy("record_at").collect()
        assert [r.fields for r in got[:2]] == [["a", "b\nc", "d"], ['x"y', "", "z"]], size
        assert got[2].reason == "open quote" and [r.record_at for r in got] == [0, 10, 20]
