"""Queries over orders, their lines and parties: alerts, the gate, coverage, frequencies, queues.

An order stands for a detection, its status for the state of the gate (P waits, O is
approved, F is rejected), its priority for the severity, a line for a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.functions.dates import any_date, compact_date, day_range, iso_date, long_date, long_form
from docstrata.functions.identifiers import alternate_url, composed, keyed_hash, valid_identifier
from docstrata.operators import coverage, gate, measure, queues, versions
from docstrata.plans.common import table
from docstrata.sinks import feeds, tables

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_RANK_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END"


def _rank() -> Column:
    return queues.rank_of(F.col("o_orderpriority"), PRIORITIES)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def _parties(spark: SparkSession, d: str) -> DataFrame:
    """The chain order, customer, nation, region."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))


# -- alerts -------------------------------------------------------------------------------


def alerts_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of approved alerts, newest first, by the visible sign."""
    human = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("neutral"))
    rows = _parties(spark, d).filter("o_orderstatus = 'O'").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), "c_name", "n_name", "r_name", gate.visible_sign(human, F.col("o_orderpriority")).alias("sign"))
    return gate.page(rows, [F.desc("day"), F.desc("o_orderkey")], limit=20, offset=40)


def alert_sample_changes(spark: SparkSession, d: str) -> DataFrame:
    """The first change of each order, and whether its description is cut."""
    lines = table(spark, d, "lineitem")
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    first = gate.first_per_group(lines, "l_orderkey", order)
    return _orders(spark, d).join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_partkey", "l_linenumber", F.col("l_shipdate").cast("date").cast("string").alias("first_ship"))


def changes_asof(spark: SparkSession, d: str) -> DataFrame:
    """Changes known when the alert was sent: lines shipped within 60 days of the order."""
    alerts = _orders(spark, d).select(F.col("o_orderkey").alias("key"), F.expr("CASE WHEN o_orderstatus <> 'F' THEN o_orderdate + INTERVAL 60 DAYS END").alias("cut"))
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("made"), "l_quantity")
    return versions.changes_as_of(alerts, changes, "key", "made", "cut").groupBy("key").agg(F.count("*").alias("changes"), F.sum("l_quantity").alias("quantity"), F.max(F.col("made").cast("date")).cast("string").alias("last_made"))


def changes_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest shipping day not after each order's cut, without pairing orders and lines."""
    asked = _orders(spark, d).select(F.col("o_orderkey").alias("key"), F.expr("o_orderdate + INTERVAL 90 DAYS").alias("cut"))
    states = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("since"))
    return versions.latest_as_of(asked, states, "key", "cut", "since").select("key", F.col("state_since").cast("date").cast("string").alias("latest"))


def findings_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an urgent waiting order and nothing approved, by the gate's findings.

    An urgent order is a report that calls for an alert, its lines are the corroborations, its
    customer is the detection in the queue, and an approved order its alert.
    """
    orders = _orders(spark, d).filter(F.col("o_orderstatus") == "P")
    reports = orders.select(F.col("o_custkey").alias("queue_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "alert").otherwise("look").alias("light"), F.array("o_orderkey").alias("corroborations"))
    queue = table(spark, d, "customer").select(F.col("c_custkey").alias("queue_id"), F.col("c_custkey").alias("detection_id"), "c_name")
    alerts = _orders(spark, d).filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("detection_id"))
    found = gate.findings(reports, queue, alerts)
    return found.groupBy(F.col("detection_id").alias("c_custkey"), "c_name").agg(F.count("*").alias("urgent"))


def unprocessed_anti(spark: SparkSession, d: str) -> DataFrame:
    """Parts without a returned line since June 2001."""
    done = table(spark, d, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz"))).select(F.col("l_partkey").alias("p_partkey"))
    return queues.missing(table(spark, d, "part"), done, "p_partkey").select("p_partkey", "p_name")


def semi_watch(spark: SparkSession, d: str) -> DataFrame:
    """Orders of watched customers: those with the most negative balances."""
    watched = table(spark, d, "customer").filter("c_acctbal < 0 and c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return _orders(spark, d).join(watched, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def left_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nation").filter("n_regionkey <> 2")
    return table(spark, d, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("nation"))


def role_playing_join(spark: SparkSession, d: str) -> DataFrame:
    """One dimension in two roles: the nations of a line's customer and of its supplier, which may be missing."""
    nation = table(spark, d, "nation")
    buyer, seller = nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("buyer")), nation.filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("s"), F.col("n_name").alias("seller"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    both = lines.join(buyer, F.col("c_nationkey") == F.col("b")).join(seller, F.col("s_nationkey") == F.col("s"), "left")
    return both.groupBy("buyer", F.coalesce("seller", F.lit("")).alias("seller")).agg(F.count("*").alias("lines"))


def documents_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of orders as summaries, newest first, of one optional status."""
    rows = _orders(spark, d).select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_orderpriority", "o_orderstatus")
    return gate.page(rows, [F.desc("day"), F.desc("o_orderkey")], limit=100, o_orderstatus="F").drop("o_orderstatus")


def document_detail(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines nested in order."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))  # of one order
    rows = _orders(spark, d).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce(F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ","), F.lit("")).alias("lines"))


def backfill_days(spark: SparkSession, d: str) -> DataFrame:
    """Days per status that no finished range covers."""
    day = F.col("o_orderdate").cast("date")
    wanted = _orders(spark, d).groupBy(F.col("o_orderstatus").alias("source")).agg(F.min(day).alias("first"), F.date_add(F.min(day), 200).alias("last"))
    done = wanted.select("source", F.date_add("first", 10).alias("first"), F.date_add("first", 150).alias("last"))
    return queues.open_days(wanted, done).select("source", F.col("day").cast("string").alias("day"))


# -- the gate -----------------------------------------------------------------------------


def gate_enqueue(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    detections = _orders(spark, d).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("detection_id"), (F.coalesce("n", F.lit(0)) >= 3).alias("admitted"))
    queue = _orders(spark, d).filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("detection_id"))
    return gate.enqueue(detections, queue)[1]


def gate_status_order(spark: SparkSession, d: str) -> DataFrame:
    """The queue after a round of decisions; only waiting items change."""
    state = F.when(F.col("o_orderstatus") == "P", gate.WAITING).when(F.col("o_orderstatus") == "O", gate.APPROVED).otherwise(gate.REJECTED)
    queue = _orders(spark, d).select(F.col("o_orderkey").alias("id"), state.alias("state"), F.lit(None).cast("string").alias("note"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("neutral")).alias("sign"))
    decisions = _orders(spark, d).filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") < "3", gate.APPROVED).otherwise(gate.REJECTED).alias("to"), F.concat(F.lit("price "), F.floor("o_totalprice").cast("string")).alias("note"), F.lit("setback").alias("sign"))
    return gate.decide(queue, decisions)


def gate_item_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Items of the gate by their key, with the warning for published ones that lost their rule."""
    items = _orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lost = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW")
    return items.select("o_orderkey", "c_name", lost.alias("warn"), F.coalesce(F.when(F.col("c_acctbal") < 0, F.lit("setback")), F.lit("unclear")).alias("sign"))


def evidence_json(spark: SparkSession, d: str) -> DataFrame:
    """Evidence as JSON and read back: fields, not the text of the JSON, are compared."""
    spans = F.array(F.struct(F.lit(0).alias("start"), F.col("o_custkey").cast("int").alias("finish")), F.struct(F.lit(None).cast("int").alias("start"), F.lit(1).alias("finish")))
    written = _orders(spark, d).select("o_orderkey", F.to_json(F.struct(F.col("o_orderpriority").alias("rule"), F.lit("2026.1").alias("version"), spans.alias("spans"))).alias("j"))
    back = written.withColumn("e", F.from_json("j", "rule string, version string, spans array<struct<start:int,finish:int>>"))
    whole = F.filter("e.spans", lambda s: s["start"].isNotNull() & s["finish"].isNotNull())  # malformed spans are dropped
    return back.select("o_orderkey", "e.rule", "e.version", F.size(whole).cast("long").alias("spans"), F.element_at(whole, 1)["finish"].cast("long").alias("finish"))


# -- coverage -----------------------------------------------------------------------------


def coverage_levels(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"), F.count_if(F.expr("c_acctbal > 0")).alias("active"), F.max("c_acctbal").alias("best"))
    suppliers = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return out.select("r_name", "n_name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "active", "suppliers")), "best")


def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Region and market segment; customers of the region AFRICA have no region here, and count in the total only."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.when(F.col("r_name") != "AFRICA", F.col("r_name")).alias("region"), F.col("c_mktsegment").alias("level"), "c_acctbal")
    return coverage.rolled_up(rows, "region", "level", F.col("c_acctbal") > 0)


def coverage_full_outer(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("key"), "n_name")
    right = table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("suppliers"))
    return coverage.with_every_region(left, right, "key", suppliers=0, n_name="")


def region_map(spark: SparkSession, d: str) -> DataFrame:
    """Per nation the worst waiting severity, the newest alert, and how many; nations without any appear."""
    waiting = _parties(spark, d).filter("o_orderstatus = 'P'").withColumn("place", -F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    worst = coverage.worst_state(waiting.withColumn("title", F.col("o_orderkey").cast("string")), "n_nationkey", -_rank(), "o_orderpriority", "title", "place", -F.col("o_orderkey"))
    return table(spark, d, "nation").join(worst, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("worst", F.lit("none")).alias("worst"), F.coalesce("first_title", F.lit("")).alias("newest"), F.coalesce("alerts", F.lit(0)).cast("long").alias("alerts"))


def sign_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bands of price with their counts, empty ones too."""
    price = F.col("o_totalprice")
    band = F.when(price < 1000, "tiny").when(price < 100000, "small").when(price < 300000, "middle").when(price < 10**9, "large").otherwise("huge")
    return coverage.banded(_orders(spark, d), band, ["tiny", "small", "middle", "large", "huge"])


def region_framework(spark: SparkSession, d: str) -> DataFrame:
    """Which of two kinds of laws a nation has, and what is known but not watched; ranked."""
    nations = table(spark, d, "nation").withColumnRenamed("n_nationkey", "key")
    suppliers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("known"), F.count_if(F.expr("s_acctbal > 0")).alias("watched"), F.collect_set(F.when(F.col("s_acctbal") > 5000, "first").otherwise("second")).alias("laws"))
    has = lambda k: F.coalesce(F.exists("laws", lambda x: x == k), F.lit(False))
    rows = nations.join(suppliers, "key", "left").select("n_name", coverage.framework(has("first"), has("second"), F.col("n_regionkey") == 4).alias("framework"), coverage.debt(F.coalesce("known", F.lit(0)), F.coalesce("watched", F.lit(0))).cast("long").alias("debt"))
    return rows.orderBy(F.desc("debt"), "n_name")


# -- frequencies and measures -------------------------------------------------------------


def most_modified_topk(spark: SparkSession, d: str) -> DataFrame:
    """In how many orders a part occurs, with the first line's flag; the 20 most frequent."""
    lines = table(spark, d, "lineitem").withColumn("place", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag"))
    return measure.most_common(measure.document_frequency(lines, "l_orderkey", "l_partkey", "l_returnflag", "place"), "l_partkey", 20)


def term_index_dump(spark: SparkSession, d: str) -> DataFrame:
    counts = measure.document_frequency(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    rows = feeds.frequency_index(counts, "l_partkey", "documents")
    return rows.select("l_partkey", F.get_json_object("json", "$.documents").cast("long").alias("documents"))


def modifier_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(_orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("versions"), F.count_distinct("l_orderkey").alias("modifiers"), F.count_distinct("o_custkey").alias("customers"))


def criteria_breakdown(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return measure.breakdown(lines, returned=F.col("l_returnflag") == "R", discounted=F.col("l_discount") > 0.05, bulky=F.col("l_quantity") >= 40, untaxed=F.col("l_tax") == 0)


def criteria_distances(spark: SparkSession, d: str) -> DataFrame:
    """What rejects a line, how many hold by the rule as it is in use, and days between order and shipment."""
    lines = table(spark, d, "lineitem").join(_orders(spark, d).select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.withColumn("days", F.abs(F.datediff("l_shipdate", "o_orderdate")))
    in_use = F.expr("l_returnflag <> 'R' AND l_discount <= 0.05 AND l_quantity < 40 AND l_tax <> 0")
    return measure.criteria_distances(rows, "days", in_use, 60, returned=F.col("l_returnflag") == "R", discounted=F.col("l_discount") > 0.05, bulky=F.col("l_quantity") >= 40, untaxed=F.col("l_tax") == 0)


def prefix_sum_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Running quantities within each order, as offsets."""
    order = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    upto = Window.partitionBy("l_orderkey").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.sum("l_quantity").over(upto).alias("finish")).withColumn("start", F.col("finish") - F.col("l_quantity"))


def stage_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a stage: seen, with a verdict, by rule, unreadable, and what they add up to."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count_if(F.expr("l_returnflag = 'R'")).alias("returned"))
    rows = _orders(spark, d).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("evaluated"), F.count_if(F.expr("returned > 0")).alias("with_verdict"), F.count_if(F.expr("quantity is null")).alias("unreadable"), F.sum("quantity").alias("pieces"), *(F.count_if(F.col("o_orderpriority") == p).alias("rule_" + p[0]) for p in PRIORITIES))


def prefix_theta_join(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name begins with any of a few prefixes."""
    prefixes = ["red", "blue w", "small r"]
    hit = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith("p_name", p))
    return table(spark, d, "part").filter(hit).select("p_partkey", "p_name")


# -- queues -------------------------------------------------------------------------------


def budgeted_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first 1000 orders by severity, and how many are pending: the budget is the feature."""
    rows = _orders(spark, d).withColumn("rank", _rank())
    taken, counts = queues.budgeted(rows, [F.asc("rank"), F.asc("o_orderdate"), F.asc("o_orderkey")], 1000)
    return taken.crossJoin(F.broadcast(counts)).select("o_orderkey", F.col("rank").cast("long").alias("rank"), "taken", "pending")  # one row of counts


def retry_fair_queue(spark: SparkSession, d: str) -> DataFrame:
    """Never tried first, then the longest ago; the first 500."""
    rows = _orders(spark, d).select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("tried_at"))
    return rows.orderBy(*queues.never_tried_first(F.col("tried_at"), F.col("o_orderkey"))).limit(500).select("o_orderkey", F.col("tried_at").cast("date").cast("string").alias("tried"))


def set_ops_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


def set_ops_intersect(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return rich.intersect(table(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


def set_ops_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")).exceptAll(table(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey").distinct())


def set_ops_bag(spark: SparkSession, d: str) -> DataFrame:
    """Bag union keeps repeats: each nation as often as both tables have it."""
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).unionAll(table(spark, d, "supplier").select("s_nationkey"))
    return both.groupBy("nation").agg(F.count("*").alias("times"))


# -- identifiers, dates, feeds ------------------------------------------------------------


def ids_and_dates(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers and dates written in several forms and read back; bad ones are null."""
    day = F.col("o_orderdate").cast("date")
    rows = _orders(spark, d).select("o_orderkey", day.alias("day"), composed("ORD", day, F.col("o_orderkey") % 10000).alias("id"), F.date_format(day, "yyyyMMdd").alias("compact"), long_form(day).alias("long"))
    bad = F.concat(F.substring("compact", 1, 4), F.lit("1345"))
    return rows.select(
        "o_orderkey", "id", valid_identifier(F.col("id"), "dated").alias("valid"), valid_identifier(F.concat("id", F.lit("\n")), "dated").alias("valid_with_newline"), compact_date(F.col("compact")).cast("string").alias("from_compact"),
        long_date(F.col("long")).cast("string").alias("from_long"), iso_date(F.col("day").cast("string")).cast("string").alias("from_iso"), any_date(bad).cast("string").alias("from_bad"), F.size(day_range(F.col("day"), F.date_add("day", 6))).cast("long").alias("days"),
    )


def download_queue(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a label wait for their body; unreadable ones get another address."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    url = F.concat(F.lit("https://archive.example/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".xml"))
    return docs.filter("quality is null and n_chars > 0").select("doc_id", url.alias("url"), F.when(F.col("n_chars") < 200, alternate_url(url)).alias("other_url"))


def listing_anti(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the labels do not know yet, null-safe."""
    return queues.missing(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def merged_results(spark: SparkSession, d: str) -> DataFrame:
    """Keyed overwrite: stage results in place of the rows with their keys."""
    stored = _orders(spark, d).select("o_orderkey", F.col("o_orderstatus").alias("state"))
    changes = _orders(spark, d).filter("o_orderstatus = 'P'").select("o_orderkey", F.lit("done").alias("state"))
    return tables.merged(stored, changes, "o_orderkey")


def email_hmac(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", keyed_hash(F.concat(F.col("c_name"), F.lit("@Example.ORG ")), "test pepper").alias("email_hash"))


def _feed_rows(spark: SparkSession, d: str, status: str) -> DataFrame:
    return _orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("id"), F.concat("c_name", F.lit(" <"), "o_orderpriority", F.lit(">")).alias("title"), F.col("o_orderdate").alias("at"), F.concat(F.lit("Total "), F.round("o_totalprice", 2).cast("string")).alias("summary"))


def atom_feed(spark: SparkSession, d: str) -> DataFrame:
    return feeds.atom(_feed_rows(spark, d, "O"), "Alerts", "alerts.example")


def feed_unreviewed(spark: SparkSession, d: str) -> DataFrame:
    return feeds.atom(_feed_rows(spark, d, "P"), "Findings", "alerts.example", prefix="UNREVIEWED · ")


QUERIES = {
    f.__name__: f
    for f in (
        alerts_page, alert_sample_changes, changes_asof, changes_latest, findings_anti, unprocessed_anti, semi_watch, left_lookup_default, role_playing_join, documents_page, document_detail, backfill_days, gate_enqueue, gate_status_order, gate_item_lookup, evidence_json,
        coverage_levels, coverage_rollup, coverage_full_outer, region_map, sign_counts, region_framework, most_modified_topk, term_index_dump, modifier_counts, criteria_breakdown, criteria_distances, prefix_sum_offsets,
        stage_summaries, prefix_theta_join, budgeted_queue, retry_fair_queue, set_ops_union, set_ops_intersect, set_ops_except, set_ops_bag, ids_and_dates, download_queue, listing_anti, merged_results,
        email_hmac, atom_feed, feed_unreviewed,
    )
}


def _sql_feed(status: str, title: str, prefix: str) -> str:
    escaped = lambda x: f"""replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
    return f"""WITH r AS (SELECT o_orderkey AS id, c_name || ' <' || o_orderpriority || '>' AS title, o_orderdate AS moment, 'Total ' || CAST(round(o_totalprice, 2) AS VARCHAR) AS summary FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus = '{status}' ORDER BY moment DESC, id DESC LIMIT 50),
e AS (SELECT moment, id, '<entry><id>tag:alerts.example,' || strftime(moment, '%Y-%m-%d') || ':' || CAST(id AS VARCHAR) || '</id><title>' || {escaped(f"'{prefix}' || title")} || '</title><updated>' || strftime(moment, '%Y-%m-%dT%H:%M:%SZ')
  || '</updated><summary type="text">' || {escaped("summary")} || '</summary></entry>' AS entry FROM r)
SELECT '<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{title}</title><id>tag:alerts.example,2026:feed</id><updated>' || strftime(max(moment), '%Y-%m-%dT%H:%M:%SZ') || '</updated>' || string_agg(entry, '' ORDER BY moment DESC, id DESC) || '</feed>' AS feed FROM e"""


SQL = {
    "atom_feed": _sql_feed("O", "Alerts", ""),
    "feed_unreviewed": _sql_feed("P", "Findings", "UNREVIEWED · "),
    "alerts_page": """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, c_name, n_name, r_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'neutral' ELSE o_orderpriority END AS sign
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' ORDER BY day DESC, o_orderkey DESC LIMIT 20 OFFSET 40""",
    "alert_sample_changes": """WITH f AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)
SELECT o_orderkey, l_partkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS first_ship FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""",
    "changes_asof": """SELECT o_orderkey AS key, count(*) AS changes, sum(l_quantity) AS quantity, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_made FROM orders JOIN lineitem ON o_orderkey = l_orderkey
AND (o_orderstatus = 'F' OR l_shipdate <= o_orderdate + INTERVAL 60 DAY) GROUP BY o_orderkey""",
    "changes_latest": "SELECT o_orderkey AS key, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS latest FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate <= o_orderdate + INTERVAL 90 DAY GROUP BY o_orderkey",
    "findings_anti": """WITH u AS (SELECT o_custkey, count(*) AS urgent FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT c_custkey, c_name, urgent FROM customer JOIN u ON c_custkey = o_custkey WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o_orderstatus = 'O')""",
    "unprocessed_anti": "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2001-06-01')",
    "semi_watch": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING')",
    "left_lookup_default": "SELECT s_suppkey, coalesce(n_name, '') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2",
    "role_playing_join": """SELECT b.n_name AS buyer, coalesce(s.n_name, '') AS seller, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation b ON c_nationkey = b.n_nationkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey AND s.n_regionkey <> 1 GROUP BY 1, 2""",
    "documents_page": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY day DESC, o_orderkey DESC LIMIT 100",
    "document_detail": """WITH l AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(lines, '') AS lines FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
    "backfill_days": """WITH w AS (SELECT o_orderstatus AS source, CAST(min(o_orderdate) AS DATE) AS f FROM orders GROUP BY 1), x AS (SELECT source, f, unnest(range(201)) AS i FROM w)
SELECT source, CAST(f + CAST(i AS INTEGER) AS VARCHAR) AS day FROM x WHERE i < 10 OR i > 150""",
    "gate_enqueue": """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT o_orderstatus = 'F' AS queued, coalesce(n, 0) >= 3 AS admitted FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT count(*) AS seen, count(*) FILTER (queued) AS already_queued, count(*) FILTER (NOT queued AND admitted) AS entered, count(*) FILTER (NOT queued AND NOT admitted) AS kept_out FROM x""",
    "gate_status_order": """WITH x AS (SELECT *, o_orderstatus = 'P' AND o_totalprice > 250000 AS acts, CASE WHEN o_orderpriority = '5-LOW' THEN 'neutral' END AS s FROM orders)
SELECT o_orderkey AS id, CASE WHEN acts THEN CASE WHEN o_orderpriority < '3' THEN 'approved' ELSE 'rejected' END ELSE CASE o_orderstatus WHEN 'P' THEN 'waiting' WHEN 'O' THEN 'approved' ELSE 'rejected' END END AS state,
  CASE WHEN acts THEN 'price ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS note, CASE WHEN acts AND s IS NULL THEN 'setback' ELSE s END AS sign FROM x""",
    "gate_item_lookup": "SELECT o_orderkey, c_name, o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AS warn, CASE WHEN c_acctbal < 0 THEN 'setback' ELSE 'unclear' END AS sign FROM orders JOIN customer ON o_custkey = c_custkey",
    "evidence_json": "SELECT o_orderkey, o_orderpriority AS rule, '2026.1' AS version, CAST(1 AS BIGINT) AS spans, CAST(o_custkey AS BIGINT) AS finish FROM orders",
    "coverage_levels": """WITH c AS (SELECT c_nationkey, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, max(c_acctbal) AS best FROM customer GROUP BY 1), s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT r_name, n_name, coalesce(total, 0) AS total, coalesce(active, 0) AS active, coalesce(suppliers, 0) AS suppliers, best FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON n_nationkey = c_nationkey LEFT JOIN s ON n_nationkey = s_nationkey""",
    "coverage_rollup": """WITH x AS (SELECT CASE WHEN r_name <> 'AFRICA' THEN r_name END AS region, c_mktsegment AS level, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT region, level, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, CASE grouping(region, level) WHEN 0 THEN 'level' WHEN 1 THEN 'region' ELSE 'total' END AS kind FROM x GROUP BY ROLLUP (region, level))
SELECT * FROM g WHERE region IS NOT NULL OR kind = 'total'""",
    "coverage_full_outer": """WITH l AS (SELECT n_nationkey AS key, n_name FROM nation WHERE n_regionkey < 3), r AS (SELECT s_nationkey AS key, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT key, coalesce(n_name, '') AS n_name, coalesce(suppliers, 0) AS suppliers FROM l FULL JOIN r USING (key)""",
    "region_map": f"""WITH w AS (SELECT n_nationkey, arg_min(o_orderpriority, {_RANK_SQL}) AS worst, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) AS newest, count(*) AS alerts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT n_nationkey, n_name, coalesce(worst, 'none') AS worst, coalesce(newest, '') AS newest, coalesce(alerts, 0) AS alerts FROM nation LEFT JOIN w USING (n_nationkey)""",
    "sign_counts": """WITH b AS (SELECT unnest([0, 1, 2, 3, 4]) AS place, unnest(['tiny', 'small', 'middle', 'large', 'huge']) AS band),
c AS (SELECT CASE WHEN o_totalprice < 1000 THEN 'tiny' WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'middle' WHEN o_totalprice < 1000000000 THEN 'large' ELSE 'huge' END AS band, count(*) AS documents FROM orders GROUP BY 1)
SELECT place, band, coalesce(documents, 0) AS documents FROM b LEFT JOIN c USING (band)""",
    "region_framework": """WITH s AS (SELECT s_nationkey AS key, count(*) AS known, count(*) FILTER (s_acctbal > 0) AS watched, count(*) FILTER (s_acctbal > 5000) > 0 AS f, count(*) FILTER (s_acctbal <= 5000) > 0 AS g FROM supplier GROUP BY 1)
SELECT n_name, CASE WHEN n_regionkey = 4 THEN 'none' WHEN f AND g THEN 'both' WHEN f THEN 'first' WHEN g THEN 'second' END AS framework, greatest(0, coalesce(known, 0) - coalesce(watched, 0)) AS debt FROM nation LEFT JOIN s ON n_nationkey = key ORDER BY debt DESC, n_name""",
    "most_modified_topk": "SELECT l_partkey, count(DISTINCT l_orderkey) AS documents, arg_min(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_returnflag)) AS l_returnflag FROM lineitem GROUP BY l_partkey ORDER BY documents DESC, l_partkey LIMIT 20",
    "term_index_dump": "SELECT l_partkey, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY l_partkey",
    "modifier_counts": "SELECT l_suppkey, count(*) AS versions, count(DISTINCT l_orderkey) AS modifiers, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey",
    "criteria_breakdown": """WITH x AS (SELECT l_returnflag = 'R' AS returned, l_discount > 0.05 AS discounted, l_quantity >= 40 AS bulky, l_tax = 0 AS untaxed FROM lineitem)
SELECT count(*) FILTER (returned) AS returned, count(*) FILTER (discounted) AS discounted, count(*) FILTER (bulky) AS bulky, count(*) FILTER (untaxed) AS untaxed, count(*) FILTER (returned OR discounted OR bulky OR untaxed) AS "any", count(*) FILTER (NOT (returned OR discounted OR bulky OR untaxed)) AS "none" FROM x""",
    "criteria_distances": """WITH x AS (SELECT l_returnflag = 'R' AS returned, l_discount > 0.05 AS discounted, l_quantity >= 40 AS bulky, l_tax = 0 AS untaxed, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT count(*) AS rows, count(*) FILTER (returned) AS returned, count(*) FILTER (discounted) AS discounted, count(*) FILTER (bulky) AS bulky, count(*) FILTER (untaxed) AS untaxed, count(*) FILTER (NOT (returned OR discounted OR bulky OR untaxed)) AS hold,
  count(*) FILTER (days <= 60) AS within, min(days) AS nearest, CAST(floor(median(days)) AS BIGINT) AS median, max(days) AS farthest FROM x""",
    "prefix_sum_offsets": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, sum(l_quantity) OVER w AS finish, sum(l_quantity) OVER w - l_quantity AS start FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)""",
    "stage_summaries": """WITH l AS (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
SELECT o_orderstatus, count(*) AS evaluated, count(*) FILTER (returned > 0) AS with_verdict, count(*) FILTER (quantity IS NULL) AS unreadable, sum(quantity) AS pieces, """
    + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS rule_{p[0]}" for p in PRIORITIES)
    + " FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY o_orderstatus",
    "prefix_theta_join": "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') OR starts_with(p_name, 'blue w') OR starts_with(p_name, 'small r')",
    "budgeted_queue": f"SELECT o_orderkey, CAST({_RANK_SQL} AS BIGINT) AS rank, least((SELECT count(*) FROM orders), 1000) AS taken, greatest((SELECT count(*) FROM orders) - 1000, 0) AS pending FROM orders ORDER BY rank, o_orderdate, o_orderkey LIMIT 1000",
    "retry_fair_queue": "SELECT o_orderkey, CAST(CAST(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS DATE) AS VARCHAR) AS tried FROM orders ORDER BY tried NULLS FIRST, o_orderkey LIMIT 500",
    "set_ops_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_ops_intersect": "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "set_ops_except": "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "set_ops_bag": "SELECT nation, count(*) AS times FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation",
    "ids_and_dates": """SELECT o_orderkey, 'ORD-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS id, true AS valid, false AS valid_with_newline, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS from_compact,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS from_long, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS from_iso, CAST(NULL AS VARCHAR) AS from_bad, CAST(7 AS BIGINT) AS days FROM orders""",
    "download_queue": """SELECT doc_id, 'https://archive.example/' || source || '/' || CAST(doc_id AS VARCHAR) || '.xml' AS url, CASE WHEN n_chars < 200 THEN 'https://archive.example/' || source || '/' || CAST(doc_id AS VARCHAR) || '.pdf' END AS other_url
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND n_chars > 0""",
    "listing_anti": "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IS NOT DISTINCT FROM documents.doc_id)",
    "merged_results": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'done' ELSE o_orderstatus END AS state FROM orders",
}
