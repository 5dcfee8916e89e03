"""Rows that fail to parse.

A quote-aware finite-state tokenizer. A chunk of text maps every possible state before it to one state after it; these
maps compose, so chunks are scanned independently of each other and the state before each chunk follows from composing
the maps of the chunks before it. Within one Arrow batch the chunks are scanned together, one vector step per position;
`chunk_transitions` and `split_chunks` do the same across the rows of a table of chunks, that is, across tasks.

Results for special input: a null or blank line gives one error `line` at offset 0 and no record; a line of any length
is scanned whole; repeated lines count each; an empty table gives empty results; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

START, BARE, QUOTED, CLOSING, BAD, NEW = range(6)  # START: a field begins; NEW: a record begins
STATES = 6
OTHER, DELIMITER, QUOTE, END, NOTHING = range(5)


def transition_table(multiline: bool) -> np.ndarray:
    """[class of a byte, state before] -> state after. In multiline mode END is a newline, which quotes protect;
    otherwise END is the end of the row, where an open quote is an error of that row only."""
    t = np.empty((5, STATES), np.uint8)
    t[OTHER] = [BARE, BARE, QUOTED, BAD, BAD, BARE]
    t[DELIMITER] = [START, START, QUOTED, START, BAD, START]
    t[QUOTE] = [QUOTED, BARE, CLOSING, QUOTED, BAD, QUOTED]
    t[END] = [NEW, NEW, QUOTED if multiline else NEW, NEW, NEW, NEW]
    t[NOTHING] = range(STATES)
    return t


def byte_classes(delimiter: str, quote: str | None, end: str | None = None) -> np.ndarray:
    lut = np.full(256, OTHER, np.uint8)
    lut[ord(delimiter)] = DELIMITER
    if quote:
        lut[ord(quote)] = QUOTE
    if end:
        lut[ord(end)] = END
    return lut


def run_states(classes: np.ndarray, table: np.ndarray, chunk: int = 2048, start: int = NEW) -> np.ndarray:
    """State before each byte, and after the last one (length n + 1)."""
    n = len(classes)
    if n == 0:
        return np.array([start], np.uint8)
    width = int(min(chunk, max(16, np.sqrt(n) // 1)))
    rows = -(-n // width)
    grid = np.full((rows, width), NOTHING, np.uint8)
    grid.reshape(-1)[:n] = classes
    steps = np.ascontiguousarray(grid.T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for step in steps:
        maps = table[step[:, None], maps]
    before = np.empty(rows, np.uint8)
    state = start
    for i in range(rows):
        before[i] = state
        state = maps[i, state]
    out = np.empty((width, rows), np.uint8)
    now = before
    for j, step in enumerate(steps):
        out[j] = now
        now = table[step, now]
    return np.append(np.ascontiguousarray(out.T).reshape(-1)[:n], np.uint8(state))


def _unquote(raw: bytes, quote: bytes) -> str:
    if raw[:1] == quote and quote:
        raw = raw[1:-1].replace(quote + quote, quote)
    return raw.decode("utf-8", "replace")


def split_rows(lines: list[str | None], delimiter: str, quote: str | None, chunk: int = 2048):
    """For each line (fields, offsets of the fields, reason, offset of the failure); offsets are in characters."""
    raw = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in lines]
    lengths = np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))
    ends = np.cumsum(lengths) - 1  # the position of each row's END
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    classes = byte_classes(delimiter, quote)[data]
    classes[ends] = END
    states = run_states(classes, transition_table(False), chunk)[:-1]
    cuts = np.flatnonzero((classes == DELIMITER) & (states != QUOTED) & (states != BAD))
    row_of = np.searchsorted(ends, cuts)
    first_cut = np.searchsorted(row_of, np.arange(len(raw) + 1))
    bad = np.flatnonzero(states == BAD)
    bad_row, bad_first = np.unique(np.searchsorted(ends, bad), return_index=True)
    wrong = {int(r): int(bad[i]) - 1 for r, i in zip(bad_row, bad_first)}  # the byte that led to BAD
    q = (quote or "").encode()
    out = []
    begin = 0
    for i, text in enumerate(raw):
        at_char = lambda b, base=text: len(base[:b].decode("utf-8", "ignore"))
        if lines[i] is None:
            out.append(([], [], "no line", 0))
        elif i in wrong:
            out.append(([], [], "text after a closing quote", at_char(wrong[i] - begin)))
        elif states[ends[i]] == QUOTED:
            out.append(([], [], "open quote", at_char(len(text))))
        else:
            at = [0, *(int(c) - begin + 1 for c in cuts[first_cut[i] : first_cut[i + 1]])]
            stop = [*(a - 1 for a in at[1:]), len(text)]
            out.append(([_unquote(text[a:b], q) for a, b in zip(at, stop)], at, None, None))
        begin = int(ends[i]) + 1
    return out


# The coded groups of a report line.
WIND = re.compile(r"([0-9]{3}|VRB)([0-9]{2})(?:G([0-9]{2}))?(MPS|KT|KMH)")
VARYING = re.compile(r"[0-9]{3}V[0-9]{3}")
CLOUD = re.compile(r"(SKC|FEW|SCT|BKN|OVC|NSC|NCD|CLR)([0-9]{3})?(CB)?")
REPORT_TYPE = re.compile(r"METAR(/SPECI)?")
VISIBILITY = re.compile(r"[0-9]{4}|CAVOK")
RUNWAY = re.compile(r"R[0-9]{2}[LRC]?/.*")
WEATHER = re.compile(r"[-+]?(RE|VC)?(MI|BC|PR|TS|BL|SH|DR|FZ)*(DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PO|SQ|FC|SS|DS|TS)+")
LATER = re.compile(r"M?[0-9]{2}/M?[0-9]{2}|[QA][0-9]{4}|NOSIG|BECMG|TEMPO|PROB[0-9]{2}")
COLUMNS = 8  # station, time, wind, visibility, clouds, temperature, pressure, trend

Group = tuple[str, int]  # text, offset in the line


def groups_in(text: str, at: int, pattern: str) -> list[Group]:
    return [(m.group(), at + m.start()) for m in re.finditer(pattern, text)]


def place_columns(fields: list[str], at: list[int]) -> tuple[list[Group], list[Group], bool]:
    """Groups in the places of wind and clouds, and whether CAVOK stands for the clouds."""
    sky = groups_in(fields[4], at[4], r"[^\s,]+")
    cavok = "CAVOK" in fields[3].split() or any(g == "CAVOK" for g, _ in sky)
    return groups_in(fields[2], at[2], r"\S+"), [g for g in sky if g[0] != "CAVOK"], cavok


def place_groups(groups: list[Group]) -> tuple[list[Group], list[Group], bool]:
    """The same for a line of blank-separated groups: [report type] station time wind visibility weather clouds ..."""
    head = 3 if groups and REPORT_TYPE.fullmatch(groups[0][0]) else 2
    body = groups[head:]
    end = next((i for i, (g, _) in enumerate(body) if LATER.fullmatch(g)), len(body))
    body = body[:end]
    sight = next((i for i, (g, _) in enumerate(body) if VISIBILITY.fullmatch(g)), None)
    if sight is None:
        stop = next((i for i, (g, _) in enumerate(body) if CLOUD.fullmatch(g) or RUNWAY.fullmatch(g) or WEATHER.fullmatch(g)), end)
        sky = body[stop:]
    else:
        stop, sky = sight, body[sight + 1 :]
    sky = [g for g in sky if not (RUNWAY.fullmatch(g[0]) or WEATHER.fullmatch(g[0]) or g[0] == "CAVOK")]
    return body[:stop], sky, any(g == "CAVOK" for g, _ in body)


def read_wind(groups: list[Group], end: int) -> tuple[dict | None, dict | None]:
    """(record, failure) of the wind place."""
    own = [g for g in groups if not VARYING.fullmatch(g[0])]
    at = own[0][1] if own else end
    if len(own) != 1:
        return None, {"expr": "WindExpr", "reason": f"{len(own)} wind groups", "at": at}
    m = WIND.fullmatch(own[0][0])
    if not m or (m[1] != "VRB" and int(m[1]) > 360):
        return None, {"expr": "WindExpr", "reason": "not a wind group: " + own[0][0], "at": at}
    return {"direction": m[1], "speed": m[2], "unit": m[4], "g": m[3]}, None


def read_clouds(groups: list[Group], cavok: bool, end: int) -> tuple[list[dict] | None, dict | None]:
    """(records, failure) of the cloud place."""
    found = []
    for text, at in groups:
        m = CLOUD.fullmatch(text)
        if not m:
            return None, {"expr": "CloudExpr", "reason": "not a cloud group: " + text, "at": at}
        found.append({"desc": m[1], "num": m[2], "cb": m[3]})
    if not found and not cavok:
        return None, {"expr": "CloudExpr", "reason": "no cloud group", "at": end}
    return found, None


def read_lines(texts: list[str | None], csv: list[bool], chunk: int = 2048) -> list[tuple[dict | None, list[dict] | None, list[dict]]]:
    """(wind record, cloud records, failures) of each line; the delimited lines and the others are tokenized together."""
    out: list = [None] * len(texts)
    for kind in (True, False):
        some = [i for i, x in enumerate(csv) if x == kind]
        for i, (fields, at, reason, where) in zip(some, split_rows([texts[i] for i in some], "," if kind else " ", '"' if kind else None, chunk)):
            text = texts[i]
            if text is None or not text.strip():
                reason, where = "empty line", 0
            elif kind and not reason and len(fields) != COLUMNS:
                reason, where = f"{len(fields)} columns", at[min(COLUMNS, len(fields) - 1)]
            if reason:
                out[i] = (None, None, [{"expr": "line", "reason": reason, "at": where}])
                continue
            if kind:
                wind, sky, cavok = place_columns(fields, at)
            else:
                wind, sky, cavok = place_groups([g for f, a in zip(fields, at) for g in groups_in(f, a, r"[^\s=]+")])
            w, w_failed = read_wind(wind, at[2] if kind else len(text))
            c, c_failed = read_clouds(sky, cavok, at[4] if kind else len(text))
            out[i] = (w, c, [x for x in (w_failed, c_failed) if x])
    return out


RECORD = "wind_expr struct<direction:string,speed:string,unit:string,g:string>, cloud_expr array<struct<desc:string,num:string,cb:string>>, failures array<struct<expr:string,reason:string,at:int>>"


def load_report_lines(df: DataFrame, key: str = "line_id", line: str = "line", layout: str = "layout", chunk: int = 2048) -> DataFrame:
    """One row per line: key, `wind_expr`, `cloud_expr` (null where unreadable) and `failures array<struct<expr,reason,at>>`
    (empty when the line is valid).

    layout `csv` marks lines of COLUMNS delimited columns; any other value, null too, means groups parted by blanks, where
    quotes have no meaning. A failure of expr `line` excludes others. `at` is a character offset into the line (for
    delimited lines that of the column, plus the place in it).
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [x if isinstance(x, str) else None for x in pdf["_line"]]
            got = read_lines(texts, [x == "csv" for x in pdf["_layout"]], chunk)
            yield pd.DataFrame({key: pdf["_key"], "wind_expr": [g[0] for g in got], "cloud_expr": [g[1] for g in got], "failures": [g[2] for g in got]})

    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(line).alias("_line"), F.col(layout).alias("_layout")).mapInPandas(read, f"`{key}` {kind}, {RECORD}")


def failed_parts(loaded: DataFrame, *keys: str) -> DataFrame:
    """One row per failing part: keys, expr, reason, at."""
    return loaded.select(*keys, F.explode("failures").alias("_f")).select(*keys, "_f.expr", "_f.reason", "_f.at")


def valid_lines(loaded: DataFrame) -> DataFrame:
    return loaded.filter(F.size("failures") == 0).drop("failures")


SPAN = 256  # chunks whose maps are composed at once


def chunk_transitions(chunks: DataFrame, content: str = "content", delimiter: str = ",", quote: str = '"') -> DataFrame:
    """Add `_map binary`: for each state before a chunk of a multi-line file the state after it."""
    table, lut = transition_table(True), byte_classes(delimiter, quote, "\n")

    @F.pandas_udf("binary")
    def maps(column: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> bytes:
            state = np.arange(STATES, dtype=np.uint8)
            classes = lut[np.frombuffer(data or b"", np.uint8)]
            width = 512
            n = len(classes) // width * width
            if n:
                grid = np.tile(state, (n // width, 1))
                for step in np.ascontiguousarray(classes[:n].reshape(-1, width).T):
                    grid = table[step[:, None], grid]
                for row in grid:
                    state = row[state]
            for c in classes[n:]:
                state = table[c, state]
            return state.tobytes()

        return column.map(one, na_action=None)

    return chunks.withColumn("_map", maps(content))


def split_chunks(chunks: DataFrame, file: str = "path", number: str = "chunk_no", content: str = "content", delimiter: str = ",", quote: str = '"') -> DataFrame:
    """Records of files that were cut into chunks anywhere, quotes and line ends inside quotes respected.

    Columns: file, record_at (byte offset of the record in its file), fields array<string>, reason. The maps of the chunks
    (six bytes each) are composed per file; a chunk then finds the record ends inside it. Every piece between record
    ends is keyed by the record it belongs to, and the pieces of one record are put together: work per task is bounded
    by the chunk and the longest record.
    """
    table, lut = transition_table(True), byte_classes(delimiter, quote, "\n")
    sized = chunk_transitions(chunks, content, delimiter, quote)
    before = W.partitionBy(file).orderBy(number).rowsBetween(W.unboundedPreceding, -1)
    states = F.transform(F.sequence(F.lit(1), F.lit(STATES)), lambda i: F.conv(F.hex(F.substring("_map", i, F.lit(1))), 16, 10).cast("int"))
    light = sized.select(file, number, F.floor(F.col(number) / SPAN).alias("_block"), states.alias("_m"), F.length(content).cast("long").alias("_n"))
    # Two levels: maps are composed inside blocks of SPAN chunks, then block by block.
    identity = F.array(*map(F.lit, range(STATES)))
    composed = lambda maps: F.aggregate(maps, identity, lambda acc, m: F.transform(acc, lambda s: F.get(m, s)))
    earlier = W.partitionBy(file, "_block").orderBy(number).rowsBetween(W.unboundedPreceding, -1)
    inner = light.select(file, number, "_block", composed(F.collect_list("_m").over(earlier)).alias("_inner"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_near"))
    blocks = light.groupBy(file, "_block").agg(F.array_sort(F.collect_list(F.struct(number, "_m"))).alias("_ms"), F.sum("_n").alias("_bn")).withColumn("_bm", composed(F.transform("_ms", lambda x: x["_m"])))
    upto = W.partitionBy(file).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    begins = F.aggregate(F.collect_list("_bm").over(upto), F.lit(NEW), lambda s, m: F.get(m, s))
    blocks = blocks.select(file, "_block", begins.alias("_begin"), F.coalesce(F.sum("_bn").over(upto), F.lit(0)).alias("_far"))
    starts = inner.join(blocks, [file, "_block"]).select(file, number, F.get("_inner", F.col("_begin")).alias("_state"), (F.col("_far") + F.col("_near")).alias("_base"))
    ready = chunks.select(file, number, content).join(starts, [file, number])
    schema = ready.select(file, number).schema.simpleString()[7:-1]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, k, data, state, base in zip(pdf[file], pdf[number], pdf[content], pdf["_state"], pdf["_base"]):
                classes = lut[np.frombuffer(data or b"", np.uint8)]
                states = run_states(classes, table, start=int(state))[:-1]
                ends = np.flatnonzero((classes == END) & (states != QUOTED)) + 1
                at = [0, *ends.tolist()]
                for i, (a, b) in enumerate(zip(at, [*at[1:], len(classes)])):
                    if b > a:
                        begun = int(base) + a if i or state == NEW else None
                        rows.append((path, k, int(base) + a, begun, bytes(data[a:b])))
            out = pd.DataFrame(rows, columns=[file, number, "_at", "_begun", "_piece"])
            yield out.assign(_begun=out["_begun"].astype("Int64"))

    cut = ready.mapInPandas(pieces, f"{schema}, _at long, _begun long, _piece binary")
    # A piece that continues a record finds its start in the chunks before: one row per chunk.
    held = cut.groupBy(file, number).agg(F.max("_begun").alias("_last"))
    carried = held.select(file, number, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    cut = cut.join(carried, [file, number]).withColumn("record_at", F.coalesce("_begun", "_carried"))
    whole = (
        cut.groupBy(file, "record_at")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
        .select(file, "record_at", F.transform("_p", lambda x: F.decode(x["_piece"], "UTF-8")).alias("_t"))
        .select(file, "record_at", F.regexp_replace(F.array_join("_t", ""), r"\r?\n$", "").alias("_line"))
    )
    out = whole.select(file, "record_at").schema.simpleString()[7:-1]

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = split_rows(list(pdf["_line"]), delimiter, quote)
            yield pdf[[file, "record_at"]].assign(fields=[d[0] for d in done], reason=[d[2] for d in done])

    return whole.mapInPandas(fields, f"{out}, fields array<string>, reason string")
