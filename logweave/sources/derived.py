"""Log-shaped tables that Spark derives from the driver's tables.

No given table holds logs, so these derive them from ``events`` (and, for
person names, ``orders``/``customer``). They scale with their inputs, and
DuckDB can build the same rows (see ``oracles.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One driver table, only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _level(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", "ERROR")
        .when(event_type == "signup", "WARN")
        .when(event_type == "view", "DEBUG")
        .otherwise("INFO")
    )


def _status(event_type: Column) -> Column:
    return F.when(event_type == "error", "500").when(event_type == "signup", "404").otherwise("200")


def logs_from_events(events: DataFrame) -> DataFrame:
    """Parsed-log table: (event_id, ts, source, time, level, service, msg)."""
    et = F.col("event_type")
    return events.select(
        "event_id",
        "ts",
        F.concat(F.lit("src"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        _level(et).alias("level"),
        F.concat(F.lit("com.shop."), et).alias("service"),
        F.concat(
            et, F.lit(" user "), F.col("user_id").cast("string"),
            F.lit(" duration="), F.floor("value").cast("bigint").cast("string"),
            F.lit("ms status "), _status(et),
            F.lit(" trace "), (F.lit(1700000000000) + F.col("event_id") % 3000).cast("string"),
        ).alias("msg"),
    )


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(table(spark, sf_dir, "events", EVENT_COLUMNS))


def raw_from_logs(lg: DataFrame, fmt: int | None = None) -> DataFrame:
    """Raw lines: (event_id, kind, source, line).

    ``fmt=None`` mixes eight formats, chosen by ``event_id % 8`` (every row is
    kept); ``fmt=k`` renders every row in format k.
    """
    kind = F.col("event_id") % 8 if fmt is None else F.lit(int(fmt)).cast("long")
    t, lv, sv, m, ts = F.col("time"), F.col("level"), F.col("service"), F.col("msg"), F.col("ts")
    etype = F.substring_index(sv, ".", -1)
    line = (
        F.when(kind == 0, F.concat(t, F.lit(" ["), lv, F.lit("] ["), sv, F.lit("] - "), m))
        .when(kind == 1, F.concat(t, F.lit("  "), lv, F.lit(" 123 --- [main] "), sv, F.lit(" : "), m))
        .when(kind == 2, F.concat(F.date_format(ts, "HH:mm:ss"), F.lit(".000 [main] "), lv, F.lit("  "), sv, F.lit(" - "), m))
        .when(kind == 3, F.concat(F.lit("["), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /item/'), etype, F.lit(' HTTP/1.1" 200')))
        .when(kind == 4, F.concat(F.date_format(ts, "MMM dd HH:mm:ss"), F.lit(" host1 "), sv, F.lit("[123]: "), m))
        .when(kind == 5, F.concat(F.lit('{"@timestamp":"'), t, F.lit('","severity":"'), F.lower(lv), F.lit('","app":"'), sv, F.lit('","message":"'), m, F.lit('"}')))
        .when(kind == 6, F.concat(lv, F.lit(" "), m))
        .otherwise(F.concat(F.lit("note: "), m))
    )
    return lg.select("event_id", kind.alias("kind"), "source", line.alias("line"))


def raw(spark: SparkSession, sf_dir: str, fmt: int | None = None) -> DataFrame:
    return raw_from_logs(logs(spark, sf_dir), fmt)


PII_NAMES = ["Alice", "王芳", "Bob Lee", "欧阳娜娜", "张三"]
# the order of the fragments and what stands between them, by ``event_id % 3``
PII_LAYOUTS = [
    (["tel", "mail", "id", "card", "ip", "org", "emp", "json", "b64"], " "),
    (["json", "ip", "tel", "org", "card", "mail", "emp", "id", "b64"], "; "),
    (["b64", "emp", "card", "id", "tel", "mail", "json", "ip", "org"], "，"),
]


def pii_from_events(events: DataFrame) -> DataFrame:
    """One text per event holding every built-in entity kind, in varied order and company: (event_id, text)."""
    n = (F.lit(10000000) + F.col("event_id")).cast("string")
    name = F.element_at(F.array(*map(F.lit, PII_NAMES)), (F.col("event_id") % len(PII_NAMES) + 1).cast("int"))
    part = {
        "tel": F.concat(F.lit("tel 138"), n),
        "mail": F.concat(F.lit("mail u"), n, F.lit("@mail.example")),
        "id": F.concat(F.lit("id 1101011990"), n),
        "card": F.concat(F.lit("card 41111111"), n),
        "ip": F.concat(F.lit("ip 10.0."), (F.col("event_id") % 256).cast("string"), F.lit(".7")),
        "org": F.concat(F.lit("org 91110108MA"), n),
        "emp": F.concat(F.lit("emp EMP"), F.substring(n, 3, 1000)),
        "json": F.concat(F.lit('{"name":"'), name, F.lit('"}')),
        "b64": F.concat(F.lit("b64 "), F.repeat(F.lit("QUJD"), (F.lit(20) + F.col("event_id") % 3).cast("int")), F.lit(" end")),
    }
    texts = [F.concat_ws(sep, *[part[k] for k in order]) for order, sep in PII_LAYOUTS]
    kind = F.col("event_id") % 3
    return events.select("event_id", F.when(kind == 0, texts[0]).when(kind == 1, texts[1]).otherwise(texts[2]).alias("text"))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_from_events(table(spark, sf_dir, "events", ["event_id"]))


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text that mentions customer names: (o_orderkey, c_name, text)."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    # shuffled: the customers grow with the orders, and Spark broadcasts them by their compressed size
    return o.join(c.hint("merge"), o.o_custkey == c.c_custkey).select(
        "o_orderkey",
        "c_name",
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" placed by "), F.col("c_name"),
                 F.lit(" status "), F.col("o_orderstatus")).alias("text"),
    )


def customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", ["c_name"]).select(F.col("c_name").alias("name"))


def json_lines_from_logs(lg: DataFrame) -> DataFrame:
    """JSON lines that probe type strictness, by ``event_id % 8``: (event_id, kind, line)."""
    kind = F.col("event_id") % 8
    t, lv, sv, m = F.col("time"), F.col("level"), F.col("service"), F.col("msg")
    eid = F.col("event_id").cast("string")
    line = (
        F.when(kind == 0, F.concat(F.lit('{"time":"'), t, F.lit('","level":"'), lv, F.lit('","msg":"'), m, F.lit('"}')))
        .when(kind == 1, F.concat(F.lit('{"time":'), eid, F.lit(',"msg":"'), m, F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"msg":null,"message":"'), m, F.lit('"}')))
        .when(kind == 3, F.concat(F.lit('{"level":null,"severity":"ERROR","msg":"'), m, F.lit('"}')))
        .when(kind == 4, F.concat(F.lit('{"msg":"first","msg":"'), m, F.lit('"}')))
        .when(kind == 5, F.concat(F.lit('{"x":'), eid, F.lit("}")))
        .when(kind == 6, F.concat(F.lit('{"service":{"a":'), eid, F.lit('},"msg":"'), m, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"loglevel":"'), F.lower(lv), F.lit('","logger":"'), sv, F.lit('","log":"'), m, F.lit('"}')))
    )
    return lg.select("event_id", kind.alias("kind"), line.alias("line"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines whose message is a document's text on one line: (doc_id, source, line)."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    one_line = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")
    return docs.select("doc_id", "source", F.concat(F.lit("2024-03-01 08:30:00 [INFO] [docs] - "), one_line).alias("line"))


def long_name_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one to five words, and Chinese names of two to five characters inside running text: (o_orderkey, name, text)."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    c = F.col("o_custkey")
    tail = F.element_at(F.array(*map(F.lit, ["", " de Borbon", " van der Berg", " Maria de la Cruz"])), (c % 4 + 1).cast("int"))
    han = F.translate(c.cast("string"), "0123456789", "零王李张刘陈杨赵黄周")
    latin = F.concat(F.lit("Nym"), F.translate(c.cast("string"), "0123456789", "abcdefghij"), tail)
    chinese = F.concat(F.lit("欧"), F.right(han, F.lit(4)))
    name = F.when(c % 3 == 0, chinese).otherwise(latin)
    text = F.concat(F.lit("订单由"), name, F.lit("签收，参见 "), F.when(c % 2 == 0, name).otherwise(F.lit("no name")), F.lit(", 完"))
    return o.select("o_orderkey", name.alias("name"), text.alias("text"))
