"""Queries of the reference's operators over the test tables, and the SQL that answers the same."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gleanery.operators import arithmetic, byte_views, control_flow, feeds, joins, layouts, ordered_lists, references, relocations, sampling, sensors, snapshots, weather_tokens
from gleanery.session import discard, scratch_path, table
from gleanery.streaming import polling

NOW = "2024-06-01"
SHORTCUTS = [("quay", "https://quay.example/feeds/"), ("moss", "https://moss.example/rss/")]
TEMPLATE = "http://{icao}.example/{network}?every={every}&x={none}"
EXPRESSION = "(a+b)*3-c/2"
CELL = 1 << 16  # events per cell of a user's series
KEY = [7 * i + 3 for i in range(16)]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""
    WITH n AS (SELECT d.id, d.torrent_url FROM download_record d LEFT JOIN subscribes s ON s.feed_name = d.feed
               WHERE d.batch_no > 0 AND d.torrent_url IS NOT NULL
                 AND NOT coalesce(regexp_matches(d.torrent_name, nullif(s.exclude_rule, '')), false))
    SELECT min(id) AS id, torrent_url FROM n
    WHERE torrent_url NOT IN (SELECT torrent_url FROM download_record WHERE batch_no = 0 AND torrent_url IS NOT NULL) GROUP BY torrent_url""")
def feed_select(spark: SparkSession, sf: str) -> DataFrame:
    d, s = table(spark, sf, "download_record"), table(spark, sf, "subscribes")
    new = d.filter("batch_no > 0").join(s.select(F.col("feed_name").alias("feed"), "exclude_rule"), "feed", "left")
    chosen = feeds.select_entries(new, "torrent_name", "exclude_rule").select("id", "torrent_url")
    return feeds.new_downloads(chosen, d.filter("batch_no = 0"), "torrent_url", "id")


@query(f"""
    SELECT feed_name, coalesce(nullif(on_air_range, 0), 90) AS range_days FROM subscribes
    WHERE date_diff('day', start_date, DATE '{NOW}') <= coalesce(nullif(on_air_range, 0), 90)""")
def on_air_filter(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.active(table(spark, sf, "subscribes"), F.lit(NOW).cast("date")).select("feed_name", "range_days")


@query("""
    SELECT feed_name, CASE WHEN starts_with(url, 'quay://') THEN 'https://quay.example/feeds/' || substr(url, 8)
                           WHEN starts_with(url, 'moss://') THEN 'https://moss.example/rss/' || substr(url, 8) ELSE url END AS url FROM subscribes""")
def shortcut_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "subscribes").select("feed_name", feeds.expand_shortcuts(F.col("url"), SHORTCUTS).alias("url"))


@query("""
    SELECT id, 1 AS pos, torrent_url AS href FROM download_record WHERE torrent_url LIKE '%.torrent'""")
def link_explode(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("torrent_url").endswith(".torrent"), feeds.TORRENT).otherwise("text/html")
    listed = F.array(F.struct(F.lit("text/html").alias("type"), F.lit("about:blank").alias("href")), F.struct(kind.alias("type"), F.col("torrent_url").alias("href")))
    return feeds.links(table(spark, sf, "download_record").withColumn("links", listed), "id").withColumn("pos", F.col("pos") + 1)


@query("""
    SELECT feed_name, '{"jsonrpc":"2.0","id":1,"method":"aria2.addTorrent","params":["token:t","' || base64(encode(url)) || '",[],{"dir":"/d/' || feed_name || '"}]}' AS payload
    FROM subscribes""")
def delivery_payload(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "subscribes").select(
        "feed_name", feeds.payload(F.col("feed_name"), F.encode("url", "UTF-8"), F.lit("/d"), F.lit("t")).alias("payload")
    )


@query("""
    SELECT 1 AS pass, count(DISTINCT torrent_url) AS recorded FROM download_record
    UNION ALL SELECT 2, 0""")
def poll_twice(spark: SparkSession, sf: str) -> DataFrame:
    """The stream polled twice: what the second pass records is nothing."""
    record, checks = scratch_path(spark, "record"), [scratch_path(spark, f"poll-{k}") for k in (1, 2)]
    schema = spark.read.parquet(f"{sf}/download_record.parquet").schema
    counts, before = [], 0
    for check in checks:
        entries = spark.readStream.schema(schema).parquet(f"{sf}/download_record.parquet*").select("id", "torrent_name", "torrent_url")
        polling.poll(entries, record, check, "id").awaitTermination()
        now = spark.read.parquet(record).count()
        counts.append(now - before)
        before = now
        discard(spark, check)
    discard(spark, record)
    return spark.createDataFrame([(k + 1, n) for k, n in enumerate(counts)], "pass int, recorded long")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_poll(spark: SparkSession, sf: str) -> DataFrame:
    """Windowed counts of a stream that is read to its end."""
    out, check = scratch_path(spark, "windows"), scratch_path(spark, "windows-check")
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    counts = polling.windowed_counts(events, "ts", "event_type")

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("window.start", "event_type", "n", F.lit(number).alias("batch")).write.mode("append").parquet(out)

    # Only counts that changed are handed on, and the state of windows past the watermark is dropped.
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    discard(spark, check)
    return spark.read.parquet(out).groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.to_date("start").alias("day"), "event_type", "n")


@query("""
    SELECT p.event_id, c.event_id AS click FROM (FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_click(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    left, right = e.filter("event_type = 'purchase'").select("event_id", "user_id", "us"), e.filter("event_type = 'click'")
    return joins.asof(left, right, "us", "us", "event_id", by=["user_id"], width=86_400_000_000, into="click").select("event_id", "click")


@query("""
    SELECT l.o_orderkey, coalesce(p.p_partkey, 0) AS start FROM orders l
    ASOF LEFT JOIN (SELECT p_partkey, p_partkey * 37 AS at FROM part) p ON l.o_orderkey >= p.at""")
def nearest_start(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 37).alias("at"))
    return joins.asof(table(spark, sf, "orders").select("o_orderkey"), starts, "o_orderkey", "at", "p_partkey", width=1000, into="start", default=0)


BANDS = "SELECT n_nationkey, 900.0 + n_nationkey * 4 AS low, 930.0 + n_nationkey * 4 AS high FROM nation"


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", (F.lit(900.0) + k * 4).alias("low"), (F.lit(930.0) + k * 4).alias("high"))


@query(f"""
    WITH b AS ({BANDS})
    SELECT n_nationkey, count(*) AS parts, min(p_partkey) AS first, max(p_partkey) AS last
    FROM part JOIN b ON p_retailprice >= low AND p_retailprice + p_size / 10.0 <= high GROUP BY 1""")
def containment(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_retailprice") + F.col("p_size") / 10.0).alias("b"))
    pairs = joins.contained_pairs(parts, _bands(spark, sf), "p_partkey", "n_nationkey", "a", "b", "low", "high", 8.0)
    return pairs.groupBy("n_nationkey").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))


@query("""
    SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE EXISTS (SELECT 1 FROM nation WHERE l_extendedprice BETWEEN 1000 * n_nationkey AND 1000 * n_nationkey + 300)""")
def point_in_range(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    ranges = table(spark, sf, "nation").select((k * 1000).alias("start"), (k * 1000 + 300).alias("end"))
    points = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return snapshots.known_addresses(points, ranges, "l_extendedprice", 100.0).select("l_orderkey", "l_linenumber")


@query("""
    SELECT event_id, user_id, previous, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
    WHERE previous <> value""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.changes(table(spark, sf, "events"), "user_id", "event_id", "value", CELL).filter("changed").select("event_id", "user_id", "previous", "value")


@query("""
    SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS gap FROM events""")
def gap_next(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.gaps(table(spark, sf, "events"), "user_id", "event_id", "event_id", "event_id", CELL).select("event_id", "gap")


@query("""
    SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block
    FROM events""")
def block_ids(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.block_numbers(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "error", CELL).select("event_id", "block")


@query("""
    WITH a AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS row_no, r_name FROM region), b AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS row_no, n_name FROM nation),
         w AS (SELECT (SELECT max(length(r_name)) FROM region) AS x, (SELECT max(length(n_name)) FROM nation) AS y)
    SELECT row_no, rpad(coalesce(r_name, ''), x::INT, ' ') || ' ' || rpad(coalesce(n_name, ''), y::INT, ' ') AS line FROM a FULL JOIN b USING (row_no), w""")
def zip_panels(spark: SparkSession, sf: str) -> DataFrame:
    return joins.zipped([(table(spark, sf, "region"), "r_regionkey", "r_name"), (table(spark, sf, "nation"), "n_nationkey", "n_name")])


@query("""
    WITH n AS (SELECT count(*) AS n FROM events), m AS (SELECT event_id, (event_id * 7 + 1) % n AS next FROM events, n)
    SELECT event_id, 0 AS depth, event_id AS address FROM events
    UNION ALL SELECT event_id, 1, next FROM m
    UNION ALL SELECT a.event_id, 2, b.next FROM m a JOIN m b ON a.next = b.event_id
    UNION ALL SELECT a.event_id, 3, c.next FROM m a JOIN m b ON a.next = b.event_id JOIN m c ON b.next = c.event_id""")
def pointer_chase(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id")
    memory = e.select("event_id", ((F.col("event_id") * 7 + 1) % F.lit(e.count())).alias("next"))
    return snapshots.chase(e.withColumn("start", F.col("event_id")), memory, "event_id", "start", "event_id", "next")


@query("""
    WITH RECURSIVE r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION ALL SELECT e.event_id, r.depth + 1 FROM r JOIN events e ON (e.event_id - 1) // 4 = r.node AND e.event_id > 0)
    SELECT 0::BIGINT AS root, node, depth FROM r""")
def reach_calls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    edges = e.filter("event_id > 0").select(F.col("event_id").alias("src"), F.floor((F.col("event_id") - 1) / 4).cast("long").alias("dst"))
    return references.callers(e.filter("event_id = 0").select(F.col("event_id").alias("root")), edges)


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.first_wins(table(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE value BETWEEN 5 AND 500 GROUP BY 1")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    checks = {"value": references.valid_address(F.col("value"), F.lit(5), F.lit(500))}
    return references.recovered_labels(table(spark, sf, "events"), "user_id", "event_type", "event_id", checks)[0]


@query("""
    SELECT event_id FROM (SELECT event_id, bool_and(event_type <> 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM events) WHERE ok""")
def prefix_take(spark: SparkSession, sf: str) -> DataFrame:
    return ordered_lists.prefix(table(spark, sf, "events"), "event_id", F.col("event_type") != "purchase", ["user_id"]).select("event_id")


@query("""
    SELECT n_name, CASE WHEN n_nationkey = 7 THEN 2 WHEN n_nationkey BETWEEN 2 AND 6 THEN n_nationkey + 1 ELSE n_nationkey END AS pos FROM nation""")
def move_index(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("pos"))
    return ordered_lists.moved_rows(n, "id", "pos", 7, 2).select("n_name", "pos")


@query("""
    WITH a AS (SELECT feed_name, row_number() OVER (ORDER BY feed_name DESC) AS was FROM subscribes WHERE length(url) % 3 > 0), b AS (SELECT feed_name, row_number() OVER (ORDER BY feed_name) AS pos FROM subscribes WHERE length(feed_name) % 2 = 0)
    SELECT feed_name, CASE WHEN pos IS NULL THEN 'remove' WHEN was IS NULL THEN 'add' WHEN was <> pos THEN 'move' ELSE 'keep' END AS action, pos::INT AS pos FROM a FULL JOIN b USING (feed_name)""")
def sync_sets(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "subscribes").select("feed_name", "url")
    shown = s.filter("length(url) % 3 > 0").withColumn("pos", F.row_number().over(W.orderBy(F.desc("feed_name"))))  # a fixed table
    wanted = s.filter("length(feed_name) % 2 = 0").withColumn("pos", F.row_number().over(W.orderBy("feed_name")))
    return ordered_lists.synchronised(shown, wanted, "feed_name", "pos")


@query("SELECT p_partkey, ((p_size - 3) % 10 + 10) % 10 AS selected FROM part")
def cyclic_select(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", ordered_lists.next_selection(F.col("p_size"), -3, F.lit(10)).alias("selected"))


@query("""
    SELECT event_id, to_json({'id': event_id::VARCHAR, 'kind': CASE event_type WHEN 'click' THEN 'C' WHEN 'error' THEN 'E' ELSE 'other' END}) AS note FROM events""")
def typed_json(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.coalesce(ordered_lists.by_type(F.col("event_type"), {"click": F.lit("C"), "error": F.lit("E")}), F.lit("other"))
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), kind.alias("kind"))).alias("note"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'paragraph' ELSE 'todo' END AS type, text AS content, CASE WHEN doc_id % 3 = 2 THEN false END AS checked
    FROM documents""")
def note_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ordered_lists.TYPES)), (F.col("doc_id") % 3 + 1).cast("int"))
    d = table(spark, sf, "documents").withColumn("stored", ordered_lists.to_text(F.array(ordered_lists.note(kind, F.col("text"), F.col("doc_id").cast("string")))))
    n = d.select("doc_id", F.get(ordered_lists.from_text(F.col("stored")), F.lit(0)).alias("n"))
    return n.select("doc_id", F.col("n.note-info.type").alias("type"), "n.content", "n.checked")


@query("SELECT event_type, round(avg(value) / 1000, 9) AS mean FROM events GROUP BY 1")
def device_mean(spark: SparkSession, sf: str) -> DataFrame:
    return sensors.device_mean(table(spark, sf, "events"), "event_type", "value").select("event_type", F.round("mean", 9).alias("mean"))


@query("""
    WITH t AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'STRTAB' WHEN 'error' THEN 'STRSZ' WHEN 'purchase' THEN 'JMPREL' WHEN 'signup' THEN 'PLTRELSZ' ELSE 'SYMTAB' END AS tag FROM events)
    SELECT user_id, max(event_id) FILTER (tag = 'STRTAB') AS "STRTAB", max(event_id) FILTER (tag = 'STRSZ') AS "STRSZ", max(event_id) FILTER (tag = 'JMPREL') AS "JMPREL",
           max(event_id) FILTER (tag = 'PLTRELSZ') AS "PLTRELSZ", max(event_id) FILTER (tag = 'SYMTAB') AS "SYMTAB", max(event_id) FILTER (tag = 'PLTRELSZ') // 24 AS entries
    FROM t GROUP BY 1""")
def tag_pivot(spark: SparkSession, sf: str) -> DataFrame:
    names = {"click": "STRTAB", "error": "STRSZ", "purchase": "JMPREL", "signup": "PLTRELSZ"}
    tag = F.coalesce(ordered_lists.by_type(F.col("event_type"), {k: F.lit(v) for k, v in names.items()}), F.lit("SYMTAB"))
    t = table(spark, sf, "events").select("user_id", tag.alias("tag"), F.col("event_id").alias("value"), F.col("event_id").alias("idx"))
    return relocations.dynamic_tables(t, "user_id").drop("error")


@query("""
    SELECT s_name AS name, min(l_orderkey * 10 + l_linenumber) AS idx FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN supplier ON s_suppkey = p_partkey % 10 + 1 GROUP BY 1""")
def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    reloc = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_partkey").alias("sym"))
    symbols = table(spark, sf, "part").select(F.col("p_partkey").alias("sym"), (F.col("p_partkey") % 10 + 1).alias("str"))
    strings = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("str"), F.col("s_name").alias("name"))
    return relocations.find_relocation(reloc, symbols, strings)


@query("""
    SELECT c_custkey, coalesce(f.n_name, lower(s.n_name), '0x' || lower(printf('%X', c_nationkey::INT))) AS name
    FROM customer LEFT JOIN (FROM nation WHERE n_nationkey < 8) f ON f.n_nationkey = c_nationkey LEFT JOIN (FROM nation WHERE n_nationkey < 16) s ON s.n_nationkey = c_nationkey""")
def name_fallback(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    functions = n.filter("n_nationkey < 8").select(F.col("n_nationkey").alias("address"), F.col("n_name").alias("name"))
    symbols = n.filter("n_nationkey < 16").select(F.col("n_nationkey").alias("address"), F.lower("n_name").alias("name"))
    return references.names_of(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("address")), functions, symbols).select("c_custkey", "name")


@query("""
    WITH b AS (SELECT icao, hex(encode(note)) AS h FROM station WHERE note <> ''), r AS (SELECT icao, h, unnest(range(0, length(h)::BIGINT // 2, 16)) AS pos FROM b),
         s AS (SELECT icao, pos, substr(h, pos * 2 + 1, 32) AS x FROM r)
    SELECT icao, lower(lpad(printf('%x', pos), 8, '0')) AS address, lower(regexp_replace(x, '(..)', '\\1 ', 'g')) AS hex,
           array_to_string(list_transform(range(0, length(x)::BIGINT // 2), lambda i: CASE WHEN ('0x' || substr(x, i * 2 + 1, 2))::INT BETWEEN 32 AND 126 THEN chr(('0x' || substr(x, i * 2 + 1, 2))::INT) ELSE '.' END), '') AS chars
    FROM s""")
def hex_rows(spark: SparkSession, sf: str) -> DataFrame:
    return byte_views.hex_rows(table(spark, sf, "station").select("icao", F.encode("note", "UTF-8").alias("c")), "icao", "c")


@query()
def hex_rows_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the whole texts of documents."""
    return byte_views.hex_rows(table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("c")), "doc_id", "c")


@query("""
    WITH h AS (SELECT hex(encode(text)) AS h FROM documents WHERE text <> ''), b AS (SELECT ('0x' || substr(h, i * 2 + 1, 2))::INT AS x FROM (SELECT h, unnest(range(0, length(h)::BIGINT // 2)) AS i FROM h))
    SELECT CASE WHEN x = 0 THEN 'GREY' WHEN x BETWEEN 33 AND 126 THEN 'BLUE' WHEN x BETWEEN 128 AND 254 THEN 'YELLOW' ELSE 'GREEN' END AS class, count(*) AS count FROM b GROUP BY 1""")
def byte_classes(spark: SparkSession, sf: str) -> DataFrame:
    return byte_views.class_counts(table(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("c")), "c")


@query("""
    SELECT doc_id, CASE WHEN contains(text, 'nvme') THEN octet_length(encode(split_part(text, 'nvme', 1))) ELSE -1 END AS at FROM documents WHERE text IS NOT NULL""")
def find_offset(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", byte_views.find_offset(F.encode("text", "UTF-8"), F.encode(F.lit("nvme"), "UTF-8")).cast("long").alias("at"))


@query(f"""
    WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
    SELECT doc_id, array_to_string(list_transform(range(0, length(h)::BIGINT // 2), lambda i: printf('%02X', xor(('0x' || substr(h, i * 2 + 1, 2))::INT, {KEY}[((i + (i >> 4)) & 15) + 1]))), '') AS hex FROM h""")
def xor_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("c"))
    return d.select("doc_id", F.hex(byte_views.xored(F.col("c"), KEY)).alias("hex"))


@query("""
    SELECT icao, replace(replace(replace('http://{icao}.example/{network}?every={every}&x={none}', '{every}', report_every::VARCHAR), '{icao}', icao), '{network}', network) AS page FROM station""")
def template_fold(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(F.lit("every"), F.col("report_every").cast("string"), F.lit("icao"), F.col("icao"), F.lit("network"), F.col("network"))
    return table(spark, sf, "station").select("icao", sensors.fill_template(F.lit(TEMPLATE), names).alias("page"))


@query("""
    SELECT user_id, '<div class="card">' || string_agg(CASE event_type WHEN 'click' THEN '<p>CPU ' || event_id || ' temperature: ' || event_id % 7 || '°C</p>' WHEN 'error' THEN '<p>Disk ' || event_id || ' temperature: ' || event_id % 7 || '°C</p>' ELSE '' END, '' ORDER BY event_id) || '</div>' AS html
    FROM events GROUP BY 1""")
def sensor_cards(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "cpu").when(F.col("event_type") == "error", "hard_disk").otherwise("other")
    e = table(spark, sf, "events").select("user_id", "event_id", kind.alias("kind"), F.col("event_id").cast("string").alias("name"), (F.col("event_id") % 7).alias("v"))
    return sensors.cards(e, "user_id", "kind", "name", "v", "event_id")


@query("""
    SELECT l_orderkey, l_linenumber, CAST((l_quantity::INT + l_linenumber) * 3 - (l_partkey % 1000) // 2 AS INT) AS result FROM lineitem""")
def arith_column(spark: SparkSession, sf: str) -> DataFrame:
    columns = {"a": F.col("l_quantity").cast("int"), "b": F.col("l_linenumber"), "c": (F.col("l_partkey") % 1000).cast("int")}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", arithmetic.compile_expression(EXPRESSION, columns).alias("result"))


@query("""
    SELECT p_partkey, CAST((p_size + p_partkey % 100) * 3 - CASE WHEN p_size % 4 = 0 THEN 0 ELSE 700 // (p_size % 4) END + -(p_size + 2) AS INT) AS value, NULL::VARCHAR AS error FROM part""")
def arith_eval(spark: SparkSession, sf: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), (F.col("p_partkey") % 100).cast("string")
    text = F.concat(F.lit("("), s, F.lit(" + "), k, F.lit(")*3 - 700/"), (F.col("p_size") % 4).cast("string"), F.lit(" + -("), s, F.lit("+2)"))
    parts = arithmetic.evaluate(table(spark, sf, "part").select("p_partkey", text.alias("t")), "t")
    return parts.select("p_partkey", "result.value", "result.error")


@query()
def weather_line_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return weather_tokens.weather_tokens(table(spark, sf, "zspd"))


# The alternatives of a report in their order, as plain expressions: the first that fits the begin of the rest is taken, and
# then a separator must follow.
ALTERNATIVES = [
    ("report", "METAR(/SPECI)*"), ("cavok", "CAVOK"), ("trend", "(NOSIG|BECMG|TEMPO|PROB[0-9][0-9]|(FM|TL|AT)[0-9]{4})"), ("icao", "[A-Z]{4}"), ("time", "[0-9]{6}Z"),
    ("wind", "([0-9]{3}|VRB)[0-9]{2}(G[0-9]{2})*(MPS|KT|KMH)"), ("vary", "[0-9]{3}V[0-9]{3}"), ("shear", "WS (LDG|TKOF) RWY[0-9]{2}L*"), ("visibility", "[0-9]{4}"), ("runway", "R[0-9]{2}[LR]*/[0-9]{4}[UDN]*"),
    ("cloud", "(SKC|FEW|SCT|BKN|OVC|NSC|NCD|CLR)([0-9]{3})*(CB)*"), ("temperature", "M*[0-9]{2}/M*[0-9]{2}"), ("pressure", "[QA][0-9]{4}"),
    ("weather", "([-+]|RE|VC)*(MI|BC|PR|TS|BL|SH|DR|FZ)*(DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PO|SQ|FC|SS|DS|TS)+"),
]
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(rest, '^{x}') THEN '{k}'" for k, x in ALTERNATIVES) + " END"
_RAW = "CASE " + " ".join(f"WHEN regexp_matches(rest, '^{x}') THEN regexp_extract(rest, '^{x}')" for _, x in ALTERNATIVES) + " END"
STEPS = f"""
    s(line_id, pos, kind, raw, rest) AS (
        SELECT line_id, -1, NULL::VARCHAR, NULL::VARCHAR, line FROM zspd WHERE line IS NOT NULL
        UNION ALL SELECT line_id, pos + 1, {_KIND}, {_RAW}, substr(rest, length({_RAW}) + 2) FROM s WHERE substr(rest, length({_RAW}) + 1, 1) IN (' ', '='))"""


@query(f"WITH RECURSIVE {STEPS} SELECT line_id, pos, kind, raw FROM s WHERE pos >= 0")
def weather_line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    t = weather_tokens.weather_tokens(table(spark, sf, "zspd"))
    # The typed table names a token by its whole shape; the first alternative that fits its begin is the same one.
    return t.select("line_id", "pos", "kind", "raw")


@query(f"""
    WITH RECURSIVE {STEPS}, u AS (SELECT line_id, coalesce(sum(length(raw) + 1) FILTER (pos >= 0), 0)::INT AS used FROM s GROUP BY 1)
    SELECT z.line_id, used, used = length(line) AS complete FROM zspd z LEFT JOIN u USING (line_id)""")
def weather_line_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return weather_tokens.consumed(table(spark, sf, "zspd"))


@query("""
    SELECT CAST(floor(epoch_us(ts) / 1800000000) AS BIGINT) AS bucket, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1""")
def sample_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.one_per_bucket(table(spark, sf, "events"), "ts", "event_id", 1800).select("bucket", "event_id")


@query("SELECT p_partkey, unnest(range(-p_size, p_size + 1, 20))::INT AS at FROM part")
def ladder(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.explode(sampling.ladder(F.col("p_size"))).alias("at"))


@query("""
    SELECT DISTINCT trim(torrent_name) AS name FROM download_record WHERE trim(torrent_name) <> '' AND trim(torrent_name) || '.torrent' NOT IN (SELECT torrent_name FROM download_record WHERE torrent_name IS NOT NULL)""")
def skip_existing(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "download_record").select("torrent_name")
    return sampling.skip_existing(sampling.batch_list(d, "torrent_name").distinct(), d.select(F.col("torrent_name").alias("name")), ".torrent")


# A program per customer: each order, by its key, is one of five shapes of five instructions (distance from its begin, name,
# argument, distance of the jump's target), a return follows the last.
SHAPES = [
    [(0, "LOAD_FAST", "left", None), (2, "LOAD_CONST", "1", None), (4, "BINARY_OP", "-", None), (6, "STORE_FAST", "left", None), (8, "NOP", None, None)],
    [(0, "LOAD_FAST", "flag", None), (2, "POP_JUMP_FORWARD_IF_FALSE", None, 10), (4, "LOAD_CONST", "2", None), (6, "STORE_FAST", "x", None), (8, "NOP", None, None)],
    [(0, "LOAD_FAST", "left", None), (2, "LOAD_CONST", "9", None), (4, "COMPARE_OP", "<", None), (6, "POP_JUMP_BACKWARD_IF_TRUE", None, -10), (8, "NOP", None, None)],
    [(0, "LOAD_FAST", "items", None), (2, "FOR_ITER", None, 10), (4, "STORE_FAST", "item", None), (6, "JUMP_BACKWARD", None, 2), (8, "NOP", None, None)],
    [(0, "LOAD_FAST", "flag", None), (2, "POP_JUMP_FORWARD_IF_TRUE", None, 8), (4, "LOAD_GLOBAL", "tick", None), (6, "JUMP_FORWARD", None, 10), (8, "LOAD_CONST", "3", None)],
]
_VALUES = ", ".join(f"({k}, {at}, '{op}', {'NULL' if arg is None else repr(arg)}, {'NULL' if to is None else to})" for k, shape in enumerate(SHAPES) for at, op, arg, to in shape)
INSTRUCTIONS = f"""
p AS (SELECT o_custkey AS prog, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 10 AS base, o_orderkey % 5 AS k FROM orders),
i AS (SELECT prog, base + s.away AS n, op, CASE WHEN dist IS NULL THEN coalesce(arg, '') ELSE 'to ' || greatest(base + dist, 0) END AS args, greatest(base + dist, 0) AS dest
      FROM p JOIN (VALUES {_VALUES}) s(k, away, op, arg, dist) USING (k)
      UNION ALL SELECT prog, max(base) + 10, 'LOAD_CONST', 'None', NULL FROM p GROUP BY 1 UNION ALL SELECT prog, max(base) + 12, 'RETURN_VALUE', '', NULL FROM p GROUP BY 1),
f AS (SELECT *, op IN ('JUMP_FORWARD', 'JUMP_BACKWARD', 'RETURN_VALUE') OR op LIKE 'POP_JUMP%' AS ending, coalesce(lag(op IN ('JUMP_FORWARD', 'JUMP_BACKWARD', 'RETURN_VALUE') OR op LIKE 'POP_JUMP%') OVER (PARTITION BY prog ORDER BY n), true) OR op = 'FOR_ITER' AS opens FROM i),
g AS (SELECT *, last_value(CASE WHEN opens THEN n END IGNORE NULLS) OVER (PARTITION BY prog ORDER BY n) AS start FROM f),
j AS (SELECT DISTINCT prog, start AS src, coalesce(dest, {control_flow.EXIT}) AS dst FROM g WHERE ending UNION SELECT prog, start, n + 2 FROM g WHERE op LIKE 'POP_JUMP%' UNION SELECT prog, n, dest FROM g WHERE op = 'FOR_ITER'),
m AS (SELECT prog, src AS n FROM j UNION SELECT prog, dst FROM j),
b AS (SELECT prog, n, ending, sum(CASE WHEN n = 0 OR m.n IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY prog ORDER BY n) AS block FROM g LEFT JOIN m USING (prog, n)),
c AS (SELECT prog, block, min(n) AS label, max(n) AS last, count(*) AS size, arg_max(ending, n) AS ends FROM b GROUP BY 1, 2)"""


def _programs(spark: SparkSession, sf: str) -> DataFrame:
    """prog_id, text: the listing of every customer's program."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("prog"), "o_orderkey")
    base = (F.row_number().over(W.partitionBy("prog").orderBy("o_orderkey")) - 1) * 10
    p = o.withColumns({"base": base, "k": F.col("o_orderkey") % 5})
    lines = lambda shape: F.concat_ws("\n", *(F.concat(F.lpad((F.col("base") + at).cast("string"), 8, " "), F.lit(f" {op}"), F.lit("") if arg is None and to is None else F.concat(F.lit(" 0 ("), F.lit(arg) if to is None else F.concat(F.lit("to "), F.greatest(F.col("base") + to, F.lit(0)).cast("string")), F.lit(")"))) for at, op, arg, to in shape))
    text = F.lit(None).cast("string")
    for k, shape in enumerate(SHAPES):
        text = F.when(F.col("k") == k, lines(shape)).otherwise(text)
    whole = p.withColumn("text", text).groupBy("prog").agg(F.array_sort(F.collect_list(F.struct("base", "text"))).alias("t"), F.max("base").alias("end"))  # one customer's orders
    ending = F.format_string("%8d LOAD_CONST 0 (None)\n%8d RETURN_VALUE", F.col("end") + 10, F.col("end") + 12)
    return whole.select(F.col("prog").cast("string").alias("prog_id"), F.concat_ws("\n", F.array_join(F.transform("t", lambda x: x["text"]), "\n"), ending).alias("text"))


@query(f"WITH {INSTRUCTIONS} SELECT prog::VARCHAR AS prog_id, n::INT AS linenum, op, args FROM i")
def program_lines(spark: SparkSession, sf: str) -> DataFrame:
    return control_flow.parse_listing(_programs(spark, sf)).select("prog_id", "linenum", "op", "args")


@query(f"WITH {INSTRUCTIONS} SELECT prog::VARCHAR AS prog_id, label::INT AS label, last::INT AS last, size::INT AS size FROM c")
def program_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return control_flow.basic_blocks(control_flow.parse_listing(_programs(spark, sf)))


EDGES = """
h AS (SELECT c.*, min(CASE WHEN ends THEN label END) OVER (PARTITION BY prog ORDER BY block ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sink, lead(label) OVER (PARTITION BY prog ORDER BY block) AS next FROM c),
e AS (SELECT DISTINCT j.prog, coalesce(h.sink, j.src) AS src, j.dst FROM j LEFT JOIN h ON h.prog = j.prog AND h.label = j.src UNION SELECT prog, label, next FROM h WHERE NOT ends AND next IS NOT NULL)"""


@query(f"WITH {INSTRUCTIONS}, {EDGES} SELECT prog::VARCHAR AS prog_id, src::INT AS src, dst::INT AS dst FROM e")
def program_edges(spark: SparkSession, sf: str) -> DataFrame:
    return control_flow.flow_edges(control_flow.parse_listing(_programs(spark, sf))).select("prog_id", "src", "dst")


@query()
def program_loops(spark: SparkSession, sf: str) -> DataFrame:
    return control_flow.loops(control_flow.flow_edges(control_flow.parse_listing(_programs(spark, sf))))


@query()
def program_regions(spark: SparkSession, sf: str) -> DataFrame:
    return control_flow.regions(control_flow.flow_edges(control_flow.parse_listing(_programs(spark, sf))))


@query()
def program_statements(spark: SparkSession, sf: str) -> DataFrame:
    return control_flow.statements(control_flow.parse_listing(_programs(spark, sf)))


@query()
def program_order(spark: SparkSession, sf: str) -> DataFrame:
    return control_flow.topological(control_flow.flow_edges(control_flow.parse_listing(_programs(spark, sf))))


# --- views of texts, registers, disks and names


@query("""
    WITH h AS (SELECT line_id, hex(encode(line)) AS h FROM zspd WHERE line <> ''), r AS (SELECT line_id, h, unnest(range(0, (length(h)::BIGINT // 2 + 15) // 16)) AS row_no FROM h),
         x AS (SELECT line_id, row_no, substr(h, row_no * 32 + 1, 32) AS x FROM r)
    SELECT line_id, row_no, rpad(lower(regexp_replace(x, '(..)', '\\1 ', 'g')), 48, ' ') ||
           array_to_string(list_transform(range(0, length(x)::BIGINT // 2), lambda i: CASE WHEN regexp_full_match(chr(('0x' || substr(x, i * 2 + 1, 2))::INT), '[\\p{L}\\p{Nd}²³¹¼½¾]') THEN chr(('0x' || substr(x, i * 2 + 1, 2))::INT) ELSE ' ' END), '') AS line FROM x""")
def log_dump(spark: SparkSession, sf: str) -> DataFrame:
    return byte_views.dump_rows(table(spark, sf, "zspd").select("line_id", F.encode("line", "UTF-8").alias("c")), "line_id", "c")


@query("""
    SELECT doc_id, CASE WHEN found > 0 THEN (64 + found - 1) // 16 ELSE 1 END::INT AS line FROM (SELECT doc_id,
        coalesce(list_position(list_transform(range(0, greatest(octet_length(encode(text)) - 64, 0)), lambda i: substr(hex(encode(text)), 129 + i * 2, 2)), '20'), 0) AS found FROM documents WHERE text IS NOT NULL)""")
def search_after_page(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", byte_views.search_line(F.encode("text", "UTF-8"), F.encode(F.lit(" "), "UTF-8"), 1, 3).alias("line"))


@query("""
    WITH k AS (SELECT p_partkey, CASE WHEN p_size >= 1 THEN p_size - 1 ELSE p_size END + 1 + 10 AS a FROM part)
    SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 40 ELSE a END - CASE WHEN CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 40 ELSE a END >= 10 THEN 10 ELSE 0 END)::INT AS line FROM k""")
def page_keys(spark: SparkSession, sf: str) -> DataFrame:
    go = F.when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 40).cast("string")).otherwise("escape")
    keys = F.array(F.lit("up"), F.lit("down"), F.lit("page_down"), go, F.lit("page_up"))
    return table(spark, sf, "part").select("p_partkey", byte_views.after_keys(keys, F.col("p_size")).alias("line"))


@query("""
    SELECT 'hard_disk' AS kind, 'sd' || lower(s_name[-1:]) AS name, s_acctbal AS temperature FROM supplier WHERE NOT regexp_matches(s_name, '[0-9]$') AND s_acctbal <> 0
    UNION ALL SELECT 'cpu', n_name, n_regionkey::DOUBLE FROM nation WHERE n_regionkey <> 0""")
def sensor_list(spark: SparkSession, sf: str) -> DataFrame:
    disks = table(spark, sf, "supplier").select(F.concat(F.lit("sd"), F.lower(F.substring("s_name", -1, 1))).alias("name"), F.col("s_acctbal").alias("t"))
    cpus = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("t"))
    return sensors.found_sensors(disks, cpus, "name", "t")


@query("""
    SELECT user_id, list_extract(string_split(line, ' '), 10) AS temperature FROM (SELECT user_id, arg_min('194 a b c d e f g h ' || event_id, event_id) FILTER (event_type = 'click') AS line FROM events GROUP BY 1)""")
def disk_report(spark: SparkSession, sf: str) -> DataFrame:
    head = F.when(F.col("event_type") == "click", "194 a b  c d e f g h ").otherwise("5 a b ")
    e = table(spark, sf, "events").select("user_id", "event_id", F.concat(head, F.col("event_id").cast("string")).alias("line"))
    return sensors.disk_temperature(e, "user_id", "event_id", "line")


@query("""
    SELECT event_id, user_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1 OR b IS DISTINCT FROM value""")
def changed_only(spark: SparkSession, sf: str) -> DataFrame:
    return ordered_lists.only_changed(table(spark, sf, "events"), "user_id", "event_id", "value", CELL).select("event_id", "user_id")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 18446744073709551616::HUGEINT - p_size ELSE p_size END::DECIMAL(20,0)::VARCHAR AS v FROM part")
def unsigned_values(spark: SparkSession, sf: str) -> DataFrame:
    signed = F.when(F.col("p_size") % 3 == 0, -F.col("p_size")).otherwise(F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", snapshots.unsigned_register(signed).cast("string").alias("v"))


@query("""
    SELECT n_name, CASE n_name WHEN 'rdi' THEN 1 ELSE list_position(['rdi', 'rsi', 'rdx', 'r10', 'r8', 'r9'], reg) END::INT AS argument_no
    FROM (SELECT n_name, CASE n_nationkey % 8 WHEN 0 THEN 'rdi' WHEN 1 THEN 'rsi' WHEN 2 THEN 'rdx' WHEN 3 THEN 'rcx' WHEN 4 THEN 'r10' WHEN 5 THEN 'r8' WHEN 6 THEN 'r9' ELSE 'rip' END AS reg FROM nation) WHERE reg NOT IN ('rcx', 'rip')""")
def argument_registers(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ["rdi", "rsi", "rdx", "rcx", "r10", "r8", "r9", "rip"]))
    n = table(spark, sf, "nation").select("n_name", F.element_at(names, (F.col("n_nationkey") % 8 + 1).cast("int")).alias("reg"))
    return snapshots.call_arguments(n, "reg", "i386:x86-64").select("n_name", F.col("argument_no").cast("int").alias("argument_no"))


@query("""
    SELECT d.id, s.exclude_rule IS NULL OR s.exclude_rule = '' OR NOT coalesce(regexp_matches(d.torrent_name, s.exclude_rule), false) AS chosen, NULL::VARCHAR AS error
    FROM download_record d LEFT JOIN subscribes s ON s.feed_name = d.feed WHERE s.feed_name IS NULL OR starts_with(s.feed_name, 'a') = false
    UNION ALL SELECT d.id, false, 'unreadable' FROM download_record d JOIN subscribes s ON s.feed_name = d.feed WHERE starts_with(s.feed_name, 'a')""")
def entries_with_bad_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Some subscriptions get a pattern that cannot be read; only their entries fail."""
    s = table(spark, sf, "subscribes").select(F.col("feed_name").alias("feed"), F.when(F.startswith("feed_name", F.lit("a")), F.lit("(")).otherwise(F.col("exclude_rule")).alias("rule"))
    judged = feeds.judged_entries(table(spark, sf, "download_record").select("id", "feed", "torrent_name"), "torrent_name", s, "feed", "rule")
    return judged.select("id", "chosen", F.when(F.col("error").isNotNull(), "unreadable").alias("error"))


def small_executable() -> bytes:
    """A 64-bit executable of our own: two loaded segments, four sections with names."""
    names = b"\0.text\0.data\0.names\0"
    head, segment, section = 64, 56, 64
    at_names = head + 2 * segment
    sections_at = at_names + len(names)
    header = bytearray(head)
    struct.pack_into("<HHIQQQIHHHHHH", header, 16, 2, 62, 1, 0x1000, head, sections_at, 0, head, segment, 2, section, 4, 3)
    seg = struct.pack("<IIQQQQQQ", 1, 5, 0, 0x1000, 0x1000, 0x200, 0x200, 4096) + struct.pack("<IIQQQQQQ", 1, 6, 0x200, 0x3000, 0x3000, 0x100, 0x180, 4096)
    sec = b"".join(
        struct.pack("<IIQQQQIIQQ", *x)
        for x in [
            (0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
            (1, 1, 6, 0x1010, 0x10, 0x100, 0, 0, 16, 0),
            (7, 1, 3, 0x3000, 0x200, 0x80, 0, 0, 8, 0),
            (13, 3, 0, 0, at_names, len(names), 0, 0, 1, 0),
        ]
    )
    return bytes(header) + seg + names + sec


def executable(number: int) -> bytes:
    """A 64-bit executable of our own that varies with the number: one to four sections besides the empty one and the names,
    in two loaded segments."""
    parts = 1 + number % 4
    names = b"\0" + b"".join(b".s%d_%d\0" % (i, number % 7) for i in range(parts)) + b".names\0"
    starts = [names.index(b".s%d_" % i) for i in range(parts)]
    at_names, base = 64 + 112, 0x1000 + number * 16
    header = bytearray(64)
    struct.pack_into("<HHIQQQIHHHHHH", header, 16, 2, 62, 1, base, 64, at_names + len(names), 0, 64, 56, 2, 64, parts + 2, parts + 1)
    loaded = struct.pack("<IIQQQQQQ", 1, 5, 0, base, base, 0x200, 0x200, 4096) + struct.pack("<IIQQQQQQ", 1, 6, 0x200, base + 0x200, base + 0x200, 0x100, 0x180, 4096)
    section = lambda *x: struct.pack("<IIQQQQIIQQ", *x)
    table_ = section(*[0] * 10) + b"".join(section(starts[i], 1, 6, base + i * 0xF0, 0x10, 0x20, 0, 0, 16, 0) for i in range(parts)) + section(names.index(b".names"), 3, 0, 0, at_names, len(names), 0, 0, 1, 0)
    return bytes(header) + loaded + names + table_


def _executables(spark: SparkSession, sf: str) -> DataFrame:
    """file, c: an executable per customer."""

    def build(batches):
        for pdf in batches:
            yield pdf.assign(c=[executable(int(k)) for k in pdf["file"]])

    numbers = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("file"))
    spread = numbers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a few MB of numbers become hundreds of MB
    return spread.mapInPandas(build, "file long, c binary")


_SECTIONS = """
x AS (SELECT c_custkey::BIGINT AS file, 1 + c_custkey % 4 AS parts, 4096 + c_custkey * 16 AS base FROM customer),
y AS (SELECT file, parts, base, unnest(range(0, parts)) AS i FROM x)"""


@query(f"""
    WITH {_SECTIONS} SELECT file, (i + 1)::INT AS idx, '.s' || i || '_' || file % 7 AS name, (base + i * 240)::INT AS addr FROM y
    UNION ALL SELECT file, 0, '', 0 FROM x UNION ALL SELECT file, (parts + 1)::INT, '.names', 0 FROM x""")
def executable_sections(spark: SparkSession, sf: str) -> DataFrame:
    found = layouts.sections(layouts.executables(_executables(spark, sf), "file", "c"), "file")
    return found.select("file", "idx", "name", F.col("addr").cast("int").alias("addr"))


@query(f"""
    WITH {_SECTIONS} SELECT file, s.idx, coalesce(string_agg('.s' || i || '_' || file % 7, ',' ORDER BY i), '') AS sections
    FROM x CROSS JOIN (VALUES (0, 0, 512), (1, 512, 896)) s(idx, low, high) LEFT JOIN y USING (file, parts, base) WHERE TRUE AND (i IS NULL OR (i * 240 >= low AND i * 240 + 32 <= high)) GROUP BY file, s.idx
    UNION ALL SELECT file, 1, '' FROM x WHERE parts < 4""")
def executable_segments(spark: SparkSession, sf: str) -> DataFrame:
    found = layouts.sections_in_segments(layouts.executables(_executables(spark, sf), "file", "c"), "file")
    return found.select("file", "idx", F.array_join("sections", ",").alias("sections"))
