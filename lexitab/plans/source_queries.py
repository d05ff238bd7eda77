"""Sources and sinks: catalogs, sidecars, archives, folders of records, exports, stores, and what is read back from them."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from lexitab.plans.fixtures import rounded
from lexitab.plans.registry import register
from lexitab.session import scratch, table, written_once
from lexitab.sources import catalog as C
from lexitab.sources import tables as S
from lexitab.streaming import incremental as I
from lexitab.streaming import reservations as R
from lexitab.streaming.store import ImmutableStore


@register("catalog_selection", "SELECT n_name AS dataset_id, n_nationkey AS entry, n_regionkey AS region FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE'))")
def catalog_selection(spark, sf_dir):
    """A catalog of JSON lines without the entries of excluded groups."""
    with scratch(spark) as folder:
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset_id"), F.col("n_nationkey").alias("entry"), F.col("n_regionkey").alias("region")).write.json(f"{folder}/catalog")
        entries = C.read_catalog(spark, f"{folder}/catalog", "dataset_id string, entry int, region int", ["dataset_id", "entry"])
        regions = table(spark, sf_dir, "region").where("r_name in ('ASIA', 'EUROPE')").select(F.col("r_regionkey").alias("region"))
        return written_once(C.selected_entries(entries, entries.join(regions, "region", "left_semi"), "dataset_id"))


def _write_customers(spark, sf_dir, folder: str) -> None:
    """Customers as CSV with a sidecar of counts and roles."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.array("c_nationkey", F.length("c_name")).alias("pair"))
    S.write_csv(customers, f"{folder}/data")
    said = {"target": "c_acctbal", "task_type": "regression", "num_rows": customers.count(), "num_columns": 5, "text_columns": ["c_name", "c_mktsegment"]}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{folder}/sidecar")


_CUSTOMERS = "c_custkey long, c_name string, c_mktsegment string, c_acctbal double, pair string"


@register("csv_with_sidecar", "SELECT c_custkey, c_name, c_mktsegment, '[' || c_nationkey || ',' || length(c_name) || ']' AS pair FROM customer")
def csv_with_sidecar(spark, sf_dir):
    """Customers written as CSV and read by their sidecar's counts; the target isn't among the inputs."""
    with scratch(spark) as folder:
        _write_customers(spark, sf_dir, folder)
        said = C.read_sidecar(spark, f"{folder}/sidecar")
        rows = S.scan_csv(spark, f"{folder}/data", _CUSTOMERS, rows=said["num_rows"], columns=said["num_columns"])
        return written_once(C.of_role(C.with_roles(rows, said["target"], said["text_columns"]), "text", "other"))


@register("csv_row_ids", "SELECT count(*) AS rows, count(*) AS ids, 0 AS first_at, count(*) - 1 AS last_at FROM customer")
def csv_row_ids(spark, sf_dir):
    """Row ids by position in a scan: one for each row, without a gap."""
    with scratch(spark) as folder:
        _write_customers(spark, sf_dir, folder)
        ids = S.with_row_ids(S.scan_csv(spark, f"{folder}/data", _CUSTOMERS)).select("row_id", F.substring_index("row_id", ":", -1).cast("long").alias("at"))
        return written_once(ids.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("row_id").alias("ids"), F.min("at").alias("first_at"), F.max("at").alias("last_at")))


@register("export_round_trip", "SELECT 'orders' AS name, 'ok' AS status, count(*) AS rows, true AS unchanged FROM orders UNION ALL SELECT 'customers', 'ok', count(*), true FROM customer")
def export_round_trip(spark, sf_dir):
    """Two tables exported with checksums and read back; another schema tag isn't accepted."""
    tables = {"orders": table(spark, sf_dir, "orders"), "customers": table(spark, sf_dir, "customer")}
    with scratch(spark) as target:
        S.write_export(spark, target, tables, schema="study/1", identity={"study": "round trip"})
        status, found = S.read_export(spark, target, schema="study/1", identity={"study": "round trip"})
        if S.read_export(spark, target, schema="study/2")[0] != "superseded_schema":
            raise ValueError("another schema was accepted")
        rows = [(name, status, *(lambda a, b: (b[0], a == b))(S.content_checksum(df), S.content_checksum(found[name]))) for name, df in tables.items()]
    return spark.createDataFrame(rows, "name string, status string, rows long, unchanged boolean")


@register("pinned_archive", "SELECT r_name AS archive, n_name || '.txt' AS member, length(n_name) + 8 AS size, sha256('Name is ' || n_name) AS sha256 FROM nation JOIN region ON n_regionkey = r_regionkey")
def pinned_archive(spark, sf_dir):
    """Members of an archive for each region, found to be what was pinned."""

    def pack(members: pa.Array) -> pa.Array:
        out = []
        for files in members.to_pylist():
            archive = io.BytesIO()
            with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as to:
                for file in files:
                    to.writestr(file["name"], file["text"])
            out.append(archive.getvalue())
        return pa.array(out, pa.binary())

    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.select(F.col("r_name").alias("path"), F.concat("n_name", F.lit(".txt")).alias("name"), F.concat(F.lit("Name is "), "n_name").alias("text"))
    archives = nations.groupBy("path").agg(F.arrow_udf(pack, "binary")(F.array_sort(F.collect_list(F.struct("name", "text")))).alias("content"))
    return C.pinned(C.archive_members(archives), nations.select(F.col("name").alias("member"), F.sha2("text", 256).alias("sha256"))).select("archive", "member", "size", "sha256")


@register("record_union", "SELECT c_mktsegment AS dataset, count(*) AS records, CAST(sum(c_nationkey) AS BIGINT) AS total FROM customer WHERE c_custkey % 5 <> 0 GROUP BY c_mktsegment")
def record_union(spark, sf_dir):
    """Records of all folders that a pattern names, those of an older schema left out."""
    records = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dataset"), F.col("c_nationkey").alias("value"), F.when(F.col("c_custkey") % 5 == 0, "record/1").otherwise("record/2").alias("schema"), (F.col("c_custkey") % 3).alias("part"))
    with scratch(spark) as folder:
        records.write.partitionBy("part").json(folder)
        found = C.union_of_records(spark, f"{folder}/part=*/*.json", "dataset string, value long, schema string", "schema", "record/2")
        return written_once(found.groupBy("dataset").agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("total")))


@register("file_inventory", "SELECT o_orderstatus, true AS stored, count(*) AS rows FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus")
def file_inventory(spark, sf_dir):
    """Files and rows of a stored table by part, without reading its cells."""
    with scratch(spark) as folder:
        table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(folder)
        return written_once(C.inventory(spark, folder, ["o_orderstatus"], F.col("o_orderstatus") == "P").select("o_orderstatus", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("stored"), "rows"))


@register("event_log", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def event_log(spark, sf_dir):
    """Events appended to a log of JSON lines in two batches, and read back."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    with scratch(spark) as folder:
        for half in (0, 1):
            C.append_events(events.where(F.col("event_id") % 2 == half), f"{folder}/log")
        return written_once(rounded(spark.read.schema(events.schema).json(f"{folder}/log").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))))


@register("compressed_cells", "SELECT count(*) AS rows, count(text) AS texts, (SELECT count(*) FROM embeddings) AS vectors FROM documents")
def compressed_cells(spark, sf_dir):
    """Texts through zlib and vectors through bytes: how many come back unchanged."""
    text = F.col("text")
    texts = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("rows"), F.count_if(C.inflated(C.deflated(text)) == text).alias("texts"))
    vector = F.col("embedding").cast("array<float>")
    vectors = table(spark, sf_dir, "embeddings").agg(F.count_if(C.float_vector(C.float_bytes(vector)).eqNullSafe(vector)).alias("vectors"))
    return texts.join(F.broadcast(vectors))  # one row


@register("stored_arrays", "SELECT r_name AS file, 'values' AS name, count(*) AS size, CAST(sum(n_nationkey) AS DOUBLE) AS total FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def stored_arrays(spark, sf_dir):
    """Numeric arrays in NPZ files, one file a region."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = nations.groupBy(F.col("r_name").alias("path")).agg(F.collect_list("n_nationkey").alias("keys")).select("path", C.npz_bytes(F.col("keys")).alias("content"))
    return C.npz_arrays(files).select("file", "name", F.col("shape")[0].alias("size"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register(
    "compute_ledger",
    """SELECT o_orderpriority AS stage, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS state, count(*) AS jobs, round(sum(CAST((o_custkey % 3600) * (o_orderkey % 8 + 1) AS DOUBLE)) / 3600, 6) AS cpu_hours,
    round(sum(CASE WHEN o_orderstatus = 'F' THEN CAST((o_custkey % 3600) * (o_orderkey % 8 + 1) AS DOUBLE) ELSE 0 END) / 3600, 6) AS done_hours FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""",
)
def compute_ledger(spark, sf_dir):
    """CPU hours of all attempts and of the successful ones, from lines of an accounting log; the last field may hold the separator."""
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("FAILED by 7")
    resources = F.concat(F.lit("billing=3,cpu="), (F.col("o_orderkey") % 8 + 1).cast("string"), F.lit(",mem=8G"))
    lines = table(spark, sf_dir, "orders").select(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority", state, (F.col("o_custkey") % 3600).cast("string"), resources, F.lit("run --a|b")).alias("value"))
    jobs = S.scan_accounting(lines, ["id", "stage", "state", "seconds", "tres", "line"])
    hours = F.col("seconds").cast("double") * S.tres("tres", "cpu") / 3600
    return rounded(jobs.groupBy("stage", "state").agg(F.count(F.lit(1)).alias("jobs"), F.sum(hours).alias("cpu_hours"), F.sum(F.when(F.col("state") == "COMPLETED", hours).otherwise(0.0)).alias("done_hours")))


@register(
    "resource_rows",
    """WITH r AS (SELECT o_orderpriority AS stage, o_custkey % 3600 AS seconds, o_orderkey % 8 + 1 AS cpus, o_custkey % 5 AS gpus FROM orders WHERE o_orderkey % 11 <> 0), e AS (SELECT stage, seconds, 'cpu' AS resource, cpus AS amount FROM r UNION ALL SELECT stage, seconds, 'gpu', gpus FROM r UNION ALL SELECT stage, seconds, 'mem', 8 FROM r)
    SELECT stage, resource, count(*) AS records, CAST(sum(amount) AS BIGINT) AS amount, round(sum(seconds * amount / 3600.0), 6) AS hours FROM e GROUP BY ALL""",
)
def resource_rows(spark, sf_dir):
    """Resources of accounting lines as rows, by a table function of SQL over a table of lines; every eleventh line has no seconds."""
    seconds = F.when(F.col("o_orderkey") % 11 == 0, "unknown").otherwise((F.col("o_custkey") % 3600).cast("string"))
    resources = F.concat(F.lit("cpu="), (F.col("o_orderkey") % 8 + 1).cast("string"), F.lit(",gpu="), (F.col("o_custkey") % 5).cast("string"), F.lit(",mem=8G,node=x"))
    lines = table(spark, sf_dir, "orders").select(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority", seconds, resources, F.lit("run --a|b")).alias("value"))
    S.register_accounting(spark, "accounting_resources", ["id", "stage", "seconds", "tres", "line"])
    rows = spark.sql("SELECT * FROM accounting_resources(TABLE({lines}))", lines=lines)
    return rounded(rows.groupBy("stage", "resource").agg(F.count(F.lit(1)).alias("records"), F.sum("amount").alias("amount"), F.sum("hours").alias("hours")))


@register("store_feed", "SELECT c_custkey AS key, round(c_acctbal, 6) AS value FROM customer")
def store_feed(spark, sf_dir):
    """Customers fed into a store page by page, in two sessions, the second of which sends a part again; its buckets double on the way."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    n = customers.count()
    with scratch(spark) as folder:
        store = ImmutableStore(spark, f"{folder}/store", customers.schema, ["key"], bucket_rows=max(1, n // 24))
        last = I.keyset_pages(customers.where(f"key <= {n // 2}"), "key", max(1, n // 3), store.put)
        I.keyset_pages(customers, "key", max(1, n // 3), store.put, after=last)
        store.put(customers.where("key % 7 = 0"))
        if not store.pending(customers).isEmpty():
            raise ValueError("the store lacks keys")
        return written_once(rounded(store.read()))


@register(
    "resumed_folds",
    "SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS fold, round(CAST(length(text) AS DOUBLE) / 7, 6) AS prediction FROM documents",
)
def resumed_folds(spark, sf_dir):
    """Predictions of five folds stored with their markers: the first run ends after two folds, the second makes the other three."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("fold"), (F.char_length("text") / 7.0).alias("prediction"))
    made = []

    def fold(name: str):
        made.append(name)
        return rows.where(F.col("fold") == int(name))

    with scratch(spark) as folder:
        store = ImmutableStore(spark, f"{folder}/store", rows.schema, ["doc_id"])
        store.run_folds(["0", "1"], fold)
        ImmutableStore(spark, f"{folder}/store", rows.schema, ["doc_id"]).run_folds([str(i) for i in range(5)], fold)
        if made != ["0", "1", "2", "3", "4"]:
            raise ValueError(f"folds were made {made}")
        return written_once(rounded(store.read()))


@register("snapshot_import", "SELECT c_custkey AS key, round(c_acctbal, 6) AS value FROM customer")
def snapshot_import(spark, sf_dir):
    """Half of the customers stored, the other half imported from an export; a repeated import, and one that disagrees, change nothing; an import can be taken back."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    with scratch(spark) as folder:
        store = ImmutableStore(spark, f"{folder}/store", customers.schema, ["key"])
        store.put(customers.where("key % 2 = 0"))
        for name, rows in (("good", customers.where("key % 3 <> 0 or key % 2 = 1")), ("bad", customers.where("key % 10 = 0").withColumn("value", F.col("value") + 1))):
            S.write_export(spark, f"{folder}/{name}", {"customers": rows}, schema="store/1", identity={"of": name})
        said = [store.import_snapshot(f"{folder}/{name}", "customers", schema=tag) for name, tag in (("good", "store/2"), ("good", "store/1"), ("good", "store/1"), ("none", "store/1"))]
        if said != ["superseded_schema", "imported", "already_imported", "awaiting_export"]:
            raise ValueError(f"imports said {said}")
        try:
            store.import_snapshot(f"{folder}/bad", "customers", schema="store/1")
            raise AssertionError("an export with other values was imported")
        except ValueError:
            pass
        full = store.manifest()["version"]
        store.restore(1)
        if store.read().count() != customers.where("key % 2 = 0").count():
            raise ValueError("the import wasn't taken back")
        store.restore(full)
        return written_once(rounded(store.read()))


def request_events(spark, sf_dir):
    """Events as those of requests: users are accounts with five requests each, values are costs."""
    kind = F.create_map(*[F.lit(x) for pair in (("view", "reserve"), ("click", "answer"), ("signup", "reject"), ("error", "error"), ("purchase", "review")) for x in pair])
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("account"), (F.col("event_id") % 5).alias("request"), "ts", kind[F.col("event_type")].alias("kind"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("cost"))


#: An account's budget and limits in the query below: two days for an answer.
RESERVATIONS = R.Limits(budget=900.0, reservation=120.0, attempts=3, timeout_us=2 * 86_400_000_000)


@register("reservation_ledger")
def reservation_ledger(spark, sf_dir):
    """Every change of every request: claims, answers, rejections, timeouts, reviews, and stops by budget or attempts."""
    return rounded(R.ledger(request_events(spark, sf_dir), RESERVATIONS))


@register("key_pages", "WITH p AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS page FROM orders WHERE o_orderkey > 100) SELECT CAST(page AS BIGINT) AS page, min(k) AS first_key, max(k) AS last_key, count(*) AS rows FROM p GROUP BY page")
def key_pages(spark, sf_dir):
    """The key ranges of pages of 1,000 orders after a key."""
    return I.page_bounds(table(spark, sf_dir, "orders"), "o_orderkey", 1000, after=100)


@register(
    "reservation_states",
    """WITH e AS (SELECT user_id, ts, event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS stage FROM events), s AS (SELECT user_id, min(struct_pack(ts := ts, kind := event_type)) FILTER (event_type = 'error') AS stop FROM e GROUP BY user_id),
    r AS (SELECT e.*, stop FROM e JOIN s USING (user_id) WHERE stop IS NULL OR struct_pack(ts := ts, kind := event_type) <= stop)
    SELECT user_id, coalesce(any_value(stop).kind, CASE max(stage) WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' END) AS state, count(*) FILTER (event_type = 'view') AS attempts FROM r GROUP BY user_id HAVING any_value(stop) IS NOT NULL OR max(stage) IS NOT NULL""",
)
def reservation_states(spark, sf_dir):
    """The furthest stage of each user's requests before the first error."""
    return I.reservation_states(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", ["view", "click", "purchase"], ["error"])
