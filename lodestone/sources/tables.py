"""The knowledge model's tables, derived from a directory of Parquet tables.

Entities and relationships come from the star schema, files and jobs from
``documents``, usage from ``events``, messages from ``conversations``. Ids are
strings built from source keys, so every engine derives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages of a file, in the order in which it passes them, then the ways to end early.
STAGES = [
    "pending", "downloading", "downloaded", "extracting", "extracted", "embedding", "embedded", "kg_done",
    "failed", "skipped", "embed_failed", "kg_failed", "cancelled",
]
#: Price of a million tokens in and out, by model (fixed values of the price list).
PRICES = {"signup": (0.25, 1.25), "error": (1.0, 5.0), "click": (3.0, 15.0), "view": (5.0, 25.0), "purchase": (15.0, 75.0)}
AS_OF = "2024-01-10 00:00:00"
#: About so many lines of orders a task when they are joined or made into edges.
LINES = 500_000


class Model:
    """Lazily built tables of one directory; ``read`` names a raw table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ------------------------------------------------------------ graph

    def entities(self) -> DataFrame:
        """id, name, entity_type, description, source_document_id."""

        def of(table: str, prefix: str, kind: Column, note: Column, source: Column) -> DataFrame:
            key = next(c for c in df[table].columns if c.endswith("key"))
            return df[table].select(_id(table, key), F.col(f"{prefix}_name").alias("name"), kind.alias("entity_type"), note.alias("description"), source.alias("source_document_id"))

        df = {t: self.read(t) for t in ("region", "nation", "customer", "supplier", "part")}
        none = F.lit(None).cast("string")
        count = self.read("documents").agg(F.count(F.lit(1)).alias("n_docs"))
        parts = df["part"].crossJoin(F.broadcast(count))  # one row
        df["part"] = parts
        source = F.when(F.col("n_docs") > 0, F.concat(F.lit("doc:"), F.col("p_partkey") % F.col("n_docs")))
        return (
            of("region", "r", F.lit("Region"), none, none)
            .union(of("nation", "n", F.lit("Nation"), none, none))
            .union(of("customer", "c", F.lit("Customer"), F.col("c_mktsegment"), none))
            .union(of("supplier", "s", F.lit("Supplier"), none, none))
            .union(of("part", "p", F.col("p_type"), F.col("p_brand"), source))
        )

    def tasks(self) -> int:
        """Tasks of what joins lines or makes edges; relationships by an end come in so many."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.read("lineitem").count() // LINES))

    def relationships(self, by: str | None = None) -> DataFrame:
        """id, source, target, relationship_type, weight. by: an end that the rows are partitioned by, so that a join on it doesn't shuffle them again.

        Pairs are shuffled once and counted there. Their tasks follow from the number
        of lines: what one holds doesn't grow with the tables.
        """
        one = F.lit(1.0)
        lines = self.read("lineitem")
        n = self.tasks()

        def pairs(df: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
            ends = df.select(a[1], b[1], *([_ref(*{"source": a, "target": b}[by]).alias(by)] if by else []))
            return ends.repartition(n, *([by] if by else ends.columns))

        def edge(df: DataFrame, kind: str, a: tuple[str, str], b: tuple[str, str], weight: Column = one) -> DataFrame:
            many = kind in ("SUPPLIED_BY", "ORDERED")
            ends = F.concat_ws(":", F.lit(kind), *([F.col(a[1])] + ([F.col(b[1])] if many else [F.lit(a[0])])))
            end = lambda name, ref: F.col(name) if many and by == name else _ref(*ref).alias(name)
            rows = df.select(ends.alias("id"), end("source", a), end("target", b), F.lit(kind).alias("relationship_type"), weight.alias("weight"))
            return rows.repartition(n, by) if by and not many else rows

        part, supplier, customer = ("part", "l_partkey"), ("supplier", "l_suppkey"), ("customer", "o_custkey")
        supplied = pairs(lines, part, supplier).distinct()
        orders = self.read("orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
        bought = lines.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        bought = pairs(bought, customer, part)
        ordered = bought.groupBy(*bought.columns).agg(F.count(F.lit(1)).alias("n"))
        return (
            edge(self.read("nation"), "IN_REGION", ("nation", "n_nationkey"), ("region", "n_regionkey"))
            .union(edge(self.read("customer"), "LOCATED_IN", ("customer", "c_custkey"), ("nation", "c_nationkey")))
            .union(edge(self.read("supplier"), "LOCATED_IN", ("supplier", "s_suppkey"), ("nation", "s_nationkey")))
            .union(edge(supplied, "SUPPLIED_BY", part, supplier))
            .union(edge(ordered, "ORDERED", customer, part, F.least(one, F.col("n") / 10)))
        )

    def candidates(self) -> DataFrame:
        """Entities as extracted, before they are merged: chunk, position, name, entity_type, description."""
        lines = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        return lines.join(self.read("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("position"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("description"),
        )

    # ------------------------------------------------------------ documents and vectors

    def documents(self) -> DataFrame:
        """One row a document, with status, source, metadata and times of upload and expiry."""
        d = self.read("documents")
        i = F.col("doc_id")
        drive = i % 2 == 1
        uploaded = F.timestamp_seconds(F.lit(1704067200) + i * 60)
        return d.select(
            F.concat(F.lit("doc:"), i).alias("id"), i, F.concat(F.lit("doc_"), i, F.when(drive, ".docx").otherwise(".pdf")).alias("filename"),
            (i % 5).cast("int").alias("user_id"),
            F.when(i % 10 == 0, "processing").when(i % 10 == 1, "failed").when(i % 10 == 2, "expired").otherwise("ready").alias("status"),
            F.when(drive, "google_drive").otherwise("upload").alias("source"), drive.alias("is_base_knowledge"),
            F.concat(F.lit('{"drive_file_id": "drive-'), i, F.lit('"}')).alias("metadata"),
            uploaded.alias("uploaded_at"), F.when(~drive, uploaded + F.expr("interval 7 days")).alias("expires_at"),
            F.col("n_chars"), F.col("lang"), F.col("source").alias("origin"), F.col("text"),
        )

    def vectors(self) -> DataFrame:
        """chunk_id, document_id, label, embedding."""
        n = self.read("documents").agg(F.count(F.lit(1)).alias("n_docs"))
        v = self.read("embeddings").crossJoin(F.broadcast(n))  # one row
        return v.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("n_docs") > 0, F.col("vec_id") % F.col("n_docs")).alias("document_id"), "label", "embedding")

    def chunks(self, size: int = 1000) -> DataFrame:
        """Documents' texts in pieces of equal length: id, document_id, chunk_index, content."""
        d = self.read("documents").where("text <> ''")
        pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one pass: a substring a chunk would pass over all before it
        return d.select("doc_id", F.posexplode(pieces).alias("chunk_index", "content")).select(
            F.concat(F.lit("chunk:"), "doc_id", F.lit(":"), "chunk_index").alias("id"), F.concat(F.lit("doc:"), "doc_id").alias("document_id"), "chunk_index", "content"
        )

    # ------------------------------------------------------------ ingestion

    def files(self) -> DataFrame:
        """Indexed files: a row a document, and an older one for every seventh."""
        d = self.read("documents")
        i = F.col("doc_id")
        created = F.lit(1704067200) + i * 60
        base = d.select(
            F.concat(F.lit("file:"), i).alias("id"), F.concat(F.lit("drive-"), i).alias("drive_file_id"), F.concat(F.lit("job:"), F.col("source")).alias("job_id"), i,
            F.concat(F.lit("doc_"), i, F.when(i % 2 == 1, ".docx").otherwise(".pdf")).alias("file_name"),
            F.concat_ws("/", "source", "lang").alias("folder_path"), (F.col("n_chars") * 100).alias("size_bytes"),
            F.get(F.array(*map(F.lit, STAGES)), (i % 13).cast("int")).alias("stage"), (i % 4).cast("int").alias("retry_count"), F.timestamp_seconds(created).alias("created_at"),
        )
        older = base.where("doc_id % 7 = 0").withColumns({"id": F.concat("id", F.lit(":old")), "stage": F.lit("failed"), "created_at": F.col("created_at") - F.expr("interval 1 day")})
        status = F.when(F.col("stage").isin("failed", "embed_failed", "kg_failed"), "failed").when(F.col("stage") == "skipped", "skipped").when(F.col("stage") == "kg_done", "completed")
        return base.union(older).withColumn("status", status.when(F.col("stage").isin("pending", "cancelled"), "pending").otherwise("processing"))

    def jobs(self) -> DataFrame:
        """A job a source, started an hour apart, with counters of its files."""
        f = self.files()
        hours = F.row_number().over(_by("job_id")) - 1  # a row a source
        tally = f.groupBy("job_id").agg(
            F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("status") == "completed").alias("processed_files"),
            F.count_if(F.col("status") == "failed").alias("failed_files"), F.count_if(F.col("status") == "skipped").alias("skipped_files"),
        )
        n = hours.cast("long")
        out = tally.withColumn("n", n).withColumn("started_at", F.timestamp_seconds(F.lit(1704067200 + 9 * 86400) - F.col("n") * 3600))
        state = F.when(F.col("n") % 4 == 0, "pending").when(F.col("n") % 4 == 1, "processing").when(F.col("n") % 4 == 2, "completed").otherwise("failed")
        none = F.lit(None).cast("string")
        more = {"status": state, "folder_id": none, "error_message": none, "completed_at": F.lit(None).cast("timestamp")}
        return out.withColumns(more).drop("n")

    # ------------------------------------------------------------ usage and chat

    def calls(self) -> DataFrame:
        """Calls of models as reported: event_id, user_id, ts, model, input_tokens, output_tokens, cost (0: unknown)."""
        k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) * 10
        out = F.floor(F.coalesce("value", F.lit(0.0)) * 10)
        cost = F.when(F.col("event_id") % 10 == 0, F.coalesce("value", F.lit(0.0)) / 100).otherwise(0.0)
        return self.read("events").select("event_id", "user_id", "ts", F.col("event_type").alias("model"), k.alias("input_tokens"), out.alias("output_tokens"), cost.alias("cost"))

    def usage(self) -> DataFrame:
        """Calls, a cost of 0 filled from the price list; a reported one stays."""
        prices = F.create_map(*[x for m, (a, b) in PRICES.items() for x in (F.lit(m), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
        price = F.coalesce(F.element_at(prices, F.col("model")), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))
        rows = self.calls().withColumn("p", price)
        listed = (F.col("input_tokens") * F.col("p.a") + F.col("output_tokens") * F.col("p.b")) / 1e6
        return rows.withColumn("cost", F.when(F.col("cost") == 0, listed).otherwise(F.col("cost"))).drop("p")

    def messages(self) -> DataFrame:
        """conversation_id, turn, role, content, user_id, created_at, token_count."""
        c = self.read("conversations")
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn"))
        return c.select(
            F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"), (F.col("conv_id") % 5).cast("int").alias("user_id"),
            at.alias("created_at"), F.floor(F.char_length("text") / 4).alias("token_count"),
        )

    def conversations(self) -> DataFrame:
        """conversation_id, user_id, title, created_at, updated_at: those with messages, and an empty one beside every tenth."""
        c = self.read("conversations").select("conv_id").distinct()
        ids = c.union(c.where("conv_id % 10 = 0").select(F.col("conv_id") + 1_000_000))
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60)
        return ids.select(
            F.col("conv_id").alias("conversation_id"), (F.col("conv_id") % 5).cast("int").alias("user_id"),
            F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Chat "), "conv_id")).alias("title"), at.alias("created_at"), at.alias("updated_at"),
        )

    def artifacts(self) -> DataFrame:
        """artifact_id, conversation_id, title, created_at: one for each third turn of a conversation."""
        c = self.read("conversations").where("turn % 3 = 1")
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn"))
        return c.select(F.concat(F.lit("artifact:"), "conv_id", F.lit(":"), "turn").alias("artifact_id"), F.col("conv_id").alias("conversation_id"), F.substring("text", 1, 80).alias("title"), at.alias("created_at"))

    def users(self) -> tuple[DataFrame, DataFrame]:
        """(users: user_id, email; accounts: user_id, provider, provider_user_id): customers, every third linked to one provider, every fifth to another."""
        c = self.read("customer")
        key = F.concat(F.lit("user:"), "c_custkey")
        account = lambda n, name: c.where(F.col("c_custkey") % n == 0).select(key.alias("user_id"), F.lit(name).alias("provider"), F.concat(F.lit(f"{name}-"), "c_custkey").alias("provider_user_id"))
        return c.select(key.alias("user_id"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email")), account(3, "google").union(account(5, "github"))

    def clusters(self) -> tuple[DataFrame, DataFrame]:
        """(clusters: id, label, parent_id; members: node_id, cluster_id): regions, nations, and who is in a nation."""
        none = F.lit(None).cast("string")
        tree = self.read("region").select(_id("region", "r_regionkey"), F.col("r_name").alias("label"), none.alias("parent_id")).union(
            self.read("nation").select(_id("nation", "n_nationkey"), F.col("n_name").alias("label"), _ref("region", "n_regionkey").alias("parent_id"))
        )
        members = self.read("customer").select(_ref("customer", "c_custkey").alias("node_id"), _ref("nation", "c_nationkey").alias("cluster_id")).union(
            self.read("supplier").select(_ref("supplier", "s_suppkey"), _ref("nation", "s_nationkey"))
        )
        return tree, members


def _ref(table: str, key: str) -> Column:
    return F.concat(F.lit(f"{table}:"), F.col(key))


def _id(table: str, key: str) -> Column:
    return _ref(table, key).alias("id")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)
