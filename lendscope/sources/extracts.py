"""Reading the bank's ``;``-separated extracts into typed, recoded tables.

``read_extract`` is a plain Spark CSV scan with an all-text schema (no
inference), so malformed fields never fail the load; ``conform`` then types
them leniently.  ``literal=True`` reads like the source's loader did: the
double quotes stay inside the text fields and the recodes match quoted codes.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lendscope.functions.birth import decode_birth
from lendscope.functions.casts import conform
from lendscope.functions.recode import (FREQUENCY_CODES, OPERATION_CODES, ORDER_SYMBOL_CODES,
                                        TRANS_SYMBOL_CODES, TRANS_TYPE_CODES, add_status_flags,
                                        recode, recode_disp_type, strip_account_zeros,
                                        strip_chars)
from lendscope.operators.dedup import dedup_first
from lendscope.sources.tables import BankTables

# ---------------------------------------------------------------------------
# Extract file names, their columns in file order, and the
# target type of each column (source DDL; 'yymmdd' marks two-digit-year dates).
# ---------------------------------------------------------------------------
EXTRACT_COLUMNS = {
    "loan": ["loan_id", "account_id", "date_", "amount", "duration", "payments", "status_"],
    "account": ["account_id", "district_id", "frequency", "date_"],
    "disp": ["disp_id", "client_id", "account_id", "type_"],
    "client": ["client_id", "birth_number", "district_id"],
    "order": ["order_id", "account_id", "bank_to", "account_to", "amount", "k_symbol"],
    "trans": ["trans_id", "account_id", "date_", "type_", "operation", "amount", "balance",
              "k_symbol", "bank", "account_"],
    "card": ["card_id", "disp_id", "type_", "issued"],
    "district": ["district_id", "district_name", "region", "n_inhab", "n_munic_less_50",
                 "n_munic_2000", "n_munic_10000", "n_munic_over", "n_cities", "urban_ratio",
                 "salary", "unemploy_95", "unemploy_96", "n_entre_p1000", "n_crimes_95",
                 "n_crimes_96"],
}
EXTRACT_TYPES = {
    "loan": {"loan_id": "int", "account_id": "int", "date_": "yymmdd", "amount": "int",
             "duration": "int", "payments": "decimal(10,2)"},
    "account": {"account_id": "int", "district_id": "int", "date_": "yymmdd"},
    "disp": {"disp_id": "int", "client_id": "int", "account_id": "int"},
    "client": {"client_id": "int", "district_id": "smallint"},
    "order": {"order_id": "int", "account_id": "int", "amount": "double"},
    "trans": {"trans_id": "int", "account_id": "int", "date_": "yymmdd",
              "amount": "decimal(15,2)"},
    "card": {"card_id": "int", "disp_id": "int", "issued": "yymmdd_time"},
    "district": {"district_id": "int", "n_inhab": "int", "n_munic_less_50": "int",
                 "n_munic_2000": "int", "n_munic_10000": "int", "n_munic_over": "int",
                 "n_cities": "int", "urban_ratio": "decimal(4,1)", "salary": "int",
                 "unemploy_95": "decimal(5,2)", "unemploy_96": "decimal(4,2)",
                 "n_entre_p1000": "int", "n_crimes_95": "int", "n_crimes_96": "int"},
}
# Types that the source's tables give to fields and that change a value: single precision and cut text.
LITERAL_TYPES = {
    "loan": {"status_": "char(3)"},
    "account": {"frequency": "varchar(20)"},
    "disp": {"type_": "varchar(12)"},
    "client": {"birth_number": "varchar(10)"},
    "order": {"bank_to": "char(5)", "account_to": "varchar(10)", "amount": "float32", "k_symbol": "varchar(12)"},
    "trans": {"type_": "varchar(16)", "operation": "varchar(17)", "balance": "varchar(15)", "k_symbol": "varchar(15)",
              "bank": "char(4)", "account_": "char(10)"},
    "card": {"type_": "varchar(10)"},
    "district": {"district_name": "char(25)", "region": "char(20)"},
}
NO_QUOTE = "\u0000"


def extract_types(name: str, literal: bool = False) -> dict[str, str]:
    """Target types of an extract's fields; ``literal`` also keeps single precision and text lengths."""
    return {**EXTRACT_TYPES[name], **(LITERAL_TYPES[name] if literal else {})}


def read_extract(spark: SparkSession, path: str, columns: list[str], sep: str = ";",
                 literal: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """Scan a delimited extract as text columns named ``columns``.

    The header line is skipped.  Intent mode strips the double quotes that
    enclose fields; literal mode keeps them (and the line's trailing CR is
    kept in the last field, as a ``\\n``-only line split does).
    """
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    reader = (spark.read.schema(schema).option("header", "true").option("sep", sep)
              .option("encoding", encoding).option("mode", "PERMISSIVE"))
    if literal:
        reader = reader.option("quote", NO_QUOTE).option("lineSep", "\n")
    else:
        reader = reader.option("quote", '"')
    return reader.csv(path)


def _path(data_dir: str, name: str) -> str:
    return f"{data_dir.rstrip('/')}/{name}.asc"


def _exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that the path names (local, HDFS, object storage)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Position of a row in its extract: file, block, row.
_ORDER = ["_metadata.file_path", "_metadata.file_block_start"]


def load_extract(spark: SparkSession, data_dir: str, name: str, literal: bool = False,
                 rejects: str | None = None, order: str | None = None, details: str | None = None) -> DataFrame:
    """Read and leniently type one extract by its file name.

    ``rejects`` adds the number of fields of a row that did not convert,
    ``details`` their names and raw text, ``order`` the row's position in
    file order.
    """
    raw = read_extract(spark, _path(data_dir, name), EXTRACT_COLUMNS[name], literal=literal)
    if order:
        raw = raw.select(*EXTRACT_COLUMNS[name],
                         F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(_ORDER)],
                                  F.monotonically_increasing_id().alias("_row")).alias(order))
    if literal:
        # numbers and dates are never quoted; only the last field may keep a CR
        last = EXTRACT_COLUMNS[name][-1]
        if last in EXTRACT_TYPES[name]:
            raw = raw.withColumn(last, strip_chars(last, "\r"))
    return conform(raw, extract_types(name, literal), rejects=rejects, details=details)


def load_rejects(spark: SparkSession, data_dir: str, literal: bool = False) -> DataFrame:
    """``(extract, n_rows, n_rejected_rows, n_rejects)``: what the lenient load could not convert."""
    parts = [load_extract(spark, data_dir, name, literal, rejects="_rejects").agg(
        F.lit(name).alias("extract"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_rejects") > 0).alias("n_rejected_rows"),
        F.coalesce(F.sum("_rejects"), F.lit(0)).alias("n_rejects"))
        for name in EXTRACT_COLUMNS if _exists(spark, _path(data_dir, name))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class LoadReport:
    """What a load read and what it could not convert.

    metrics   extract -> ``n_rows, n_rejected_rows, n_rejects``
    rejects   extract, row (position in the extract), column, raw text
    """

    metrics: dict[str, dict[str, int]]
    rejects: DataFrame


def load_checked(spark: SparkSession, data_dir: str, path: str, literal: bool = False,
                 allow_missing: Collection[str] = ()) -> tuple[BankTables, LoadReport]:
    """Load all extracts once, with their rejects.

    Every extract is read in one pass that types it, observes the counts and
    writes the typed rows (with what did not convert) as Parquet under
    ``path``; tables and rejects are read from there, so no file is parsed
    twice and a lost executor costs no second parse.
    """
    metrics: dict[str, dict[str, int]] = {}
    kept: dict[str, DataFrame] = {}
    for name in EXTRACT_COLUMNS:
        if not _exists(spark, _path(data_dir, name)):
            continue
        seen = Observation(f"load-{name}")
        typed = load_extract(spark, data_dir, name, literal, rejects="_rejects", order="_seq", details="_failed")
        typed.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_rejects") > 0).alias("n_rejected_rows"),
                      F.coalesce(F.sum("_rejects"), F.lit(0)).alias("n_rejects")).write.parquet(f"{path.rstrip('/')}/{name}")
        metrics[name] = dict(seen.get)
        kept[name] = spark.read.schema(typed.schema).parquet(f"{path.rstrip('/')}/{name}")
    none = spark.createDataFrame([], "extract string, row struct<_0:string,_1:bigint,_row:bigint>, column string, raw string")
    rejects = none
    for name, df in kept.items():
        failed = df.where("_rejects > 0").select("_seq", F.explode("_failed").alias("f"))
        rejects = rejects.unionByName(failed.select(F.lit(name).alias("extract"), F.col("_seq").alias("row"), "f.column", "f.raw"))
    tables = load_bank_tables(spark, data_dir, literal, allow_missing,
                              read=lambda name, order: kept[name].withColumn(order, F.col("_seq")).drop(
                                  "_rejects", "_failed", *([] if order == "_seq" else ["_seq"])) if order
                              else kept[name].drop("_rejects", "_failed", "_seq"))
    return tables, LoadReport(metrics, rejects)


def load_bank_tables(spark: SparkSession, data_dir: str, literal: bool = False,
                     allow_missing: Collection[str] = (),
                     read: Callable[[str, str | None], DataFrame] | None = None) -> BankTables:
    """All extracts in ``data_dir`` as typed, recoded :class:`BankTables`.

    Every extract must be there; ``allow_missing={'trans'}`` accepts an absent
    transactions file (it is not always shipped) as an empty table.  ``read``
    gives typed extracts from elsewhere (name, order column or ``None``).
    """
    absent = [n for n in EXTRACT_COLUMNS if not _exists(spark, _path(data_dir, n))]
    if set(absent) - (set(allow_missing) & {"trans"}):
        raise FileNotFoundError(f"missing extracts in {data_dir}: {', '.join(absent)}")
    seq = "_load_seq"

    def load(name: str) -> DataFrame | None:
        order = seq if name in ("loan", "client") else None
        if name in absent:
            return None
        return read(name, order) if read else load_extract(spark, data_dir, name, literal, order=order)

    loans = load("loan")
    loans = dedup_first(loans, ["loan_id"], [seq]).drop(seq)
    loans = add_status_flags(loans.withColumn("status_", strip_chars("status_", '"\r')))

    accounts = load("account").withColumn(
        "frequency", recode("frequency", FREQUENCY_CODES, literal=literal))

    disp = load("disp").withColumn("type_", recode_disp_type("type_", literal=literal))

    clients = load("client")
    clients = dedup_first(clients, ["client_id"], [seq]).drop(seq)
    clients = decode_birth(clients, "birth_number", literal=literal)

    orders = load("order").withColumn(
        "k_symbol", strip_chars(recode("k_symbol", ORDER_SYMBOL_CODES, literal=literal), "\r"))

    trans = load("trans")
    if trans is None:
        trans = spark.createDataFrame(
            [], "trans_id int, account_id int, date_ date, type_ string, operation string, "
                "amount decimal(15,2), balance string, k_symbol string, bank string, "
                "account_ string")
    else:
        sym = recode("k_symbol", TRANS_SYMBOL_CODES, literal=literal)
        trans = (trans
                 .withColumn("type_", recode("type_", TRANS_TYPE_CODES, literal=literal))
                 .withColumn("operation", recode("operation", OPERATION_CODES, literal=literal))
                 .withColumn("account_", strip_account_zeros("account_", literal=literal))
                 .withColumn("k_symbol", strip_chars(sym, '"') if literal else sym))

    cards = load("card")
    if literal:
        cards = cards.withColumn("type_", strip_chars("type_", '"'))
    district = load("district")
    return BankTables(loans=loans, accounts=accounts, disp=disp, clients=clients, orders=orders,
                      trans=trans, cards=cards,
                      card_links=disp.select("disp_id", "account_id"), district=district)
