"""Mixed timestamp layouts and zones, normalised to one UTC instant.

Raw strings are reduced to a dictionary of distinct (source, raw, zone), each entry is parsed once by
built-in expressions, the dictionary may be kept and grown from run to run, and instants are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.shared import materialize

# English month abbreviations in calendar order.
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_ZONE = r"(?:Z|z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|UTC|GMT)"
_CLOCK = rf"^\d{{4}}:\d\d:\d\d \d\d:\d\d:[0-5]\d(?:\.\d+)?\s*{_ZONE}?$"


def offset_zone(text: Column) -> Column:
    """An offset such as +1, -07:00, +0530, UTC+05:45 or Z as '+hh:mm'; null where it is none.

    Blank text and offsets beyond 18 hours or with more than 59 minutes are no offsets.
    """
    s = F.upper(F.translate(F.trim(text), "−", "-"))
    hh = F.lpad(F.regexp_extract(s, r"^(?:UTC|GMT)?[+-](\d{1,2}?)(?::?(\d{2}))?$", 1), 2, "0")
    mm = F.regexp_extract(s, r"^(?:UTC|GMT)?[+-](\d{1,2}?)(?::?(\d{2}))?$", 2)
    mm = F.when(mm == "", "00").otherwise(mm)
    sign = F.regexp_extract(s, r"([+-])", 1)
    ok = s.rlike(r"^(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?$") & (mm <= "59") & ((hh < "18") | ((hh == "18") & (mm == "00")))
    return F.when(s.isin("Z", "UTC", "GMT"), F.lit("+00:00")).when(ok, F.concat(sign, hh, F.lit(":"), mm))


def parse_instants(rows: DataFrame, raw: str = "raw", zone: str = "zone", out: str = "micros") -> DataFrame:
    """``rows`` with ``out``: microseconds since the Unix epoch (BIGINT) of the text ``raw``; null where it is no valid date.

    Layouts: year:month:day or year-month-day with a blank or T before the time; yyyymmddThhmmss; day Mon year;
    each with fractions of a second and a zone if there are any; or a bare number of Unix seconds, of
    milliseconds from 1e11 on.  A zone in the text counts, else ``zone`` (an IANA name or offset).  Of a
    repeated local hour the first is taken; a skipped one moves forward by the gap.  Years 1 to 9999.
    """
    s = F.col("__s")
    # Compact and dashed dates are brought to the layout with colons, then worded ones; the rest is by position.
    text = F.regexp_replace(F.trim(F.col(raw)), r"\s+", " ")
    text = F.regexp_replace(text, r"^(\d{4})(\d\d)(\d\d)[Tt ](\d\d)(\d\d)(\d\d)(?=\D|$)", "$1:$2:$3 $4:$5:$6")
    text = F.regexp_replace(text, r"^(\d{4})-(\d\d)-(\d\d)[Tt ](?=\d\d:)", "$1:$2:$3 ")
    rows = rows.withColumn("__s", text)
    words = r"^(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (.*)$"
    day = F.lpad(F.regexp_extract(s, words, 1), 2, "0")
    worded = F.concat(F.regexp_extract(s, words, 3), F.lit(":"), _month(s), F.lit(":"), day, F.lit(" "), F.regexp_extract(s, words, 4))
    rows = rows.withColumn("__s", F.when(s.rlike(words), worded).otherwise(s))
    dated = F.when(s.rlike(_CLOCK), s)
    part = lambda at, n: F.substring("__d", at, n).cast("int")
    rows = rows.withColumn("__d", dated)
    rows = rows.withColumns(
        {
            "__t": F.try_make_timestamp(part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2).cast("decimal(16,6)"), F.lit("UTC")),
            "__own": offset_zone(F.regexp_extract("__d", rf"^.{{19}}(?:\.\d+)?\s*({_ZONE})$", 1)),
            "__f": F.rpad(F.substring(F.regexp_extract("__d", r"^.{19}\.(\d+)", 1), 1, 6), 6, "0").try_cast("int"),
            "__n": F.when(s.rlike(r"^-?\d{1,17}(?:\.\d+)?$"), s).try_cast("decimal(30,9)"),
        }
    )
    local = F.unix_micros(F.to_utc_timestamp("__t", F.coalesce("__own", zone))) + F.coalesce("__f", F.lit(0))
    unix = F.when(F.abs("__n") >= 100_000_000_000, F.col("__n") * 1000).otherwise(F.col("__n") * 1_000_000)
    return rows.withColumn(out, F.coalesce(local, F.floor(unix).try_cast("bigint"))).drop("__s", "__d", "__t", "__own", "__f", "__n")


def _month(s: Column) -> Column:
    """The month of a worded date as two digits; '00', which is no month, where it is no abbreviation."""
    name = F.initcap(F.regexp_extract(s, r"^\d{1,2} ([A-Za-z]{3}) ", 1))
    return F.lpad(F.coalesce(*[F.when(name == _MONTHS[3 * i : 3 * i + 3], F.lit(str(i + 1))) for i in range(12)], F.lit("0")), 2, "0")


def known_zone(spark: SparkSession, zone: Column) -> Column:
    """The zone's name, or UTC where it is null, blank or unknown.  The list of names is Java's, of fixed size."""
    names = list(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    return F.when(F.trim(zone).isin(names), F.trim(zone)).otherwise(F.lit("UTC"))


def instant_dictionary(keys: DataFrame, path: str | None = None) -> DataFrame:
    """The dictionary (source, raw, zone, micros) of ``keys`` (source, raw, zone), each distinct key parsed once.

    With ``path`` it is persistent: entries kept there are read, only new keys are parsed and appended.
    Two runs at once may both append a key; it is read as one entry all the same, since equal keys have equal instants.
    Without, it is written to the session's shared folder.  Null raws are no keys.
    """
    spark = keys.sparkSession
    keys = keys.where(F.col("raw").isNotNull()).select("source", "raw", "zone").distinct()
    if path is None:
        return materialize(parse_instants(keys), "instants")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        keys = keys.join(spark.read.parquet(path), ["source", "raw", "zone"], "left_anti")
    parse_instants(keys).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("source", "raw", "zone").agg(F.max("micros").alias("micros"))


def normalise_instants(
    rows: DataFrame,
    sources: list[tuple[str, Column, Column]],
    out: str = "instant_us",
    path: str | None = None,
) -> DataFrame:
    """``rows`` with ``out``: microseconds since the epoch from the first of ``sources`` that is a valid date.

    ``sources`` holds (name, raw text, zone that counts where the text names none) by falling priority.
    Text without a digit is no date and gets no key; rows without a key are spread, not sent to one task.
    The result is null where no source is valid.  Repeated rows stay; other columns pass through.
    """
    raws = [(name, F.when(F.trim(raw).rlike("[0-9]"), F.trim(raw)), zone) for name, raw, zone in sources]
    rows = rows.withColumns({f"__raw{i}": r for i, (_, r, _z) in enumerate(raws)} | {f"__zone{i}": z for i, (_, _r, z) in enumerate(raws)})
    entry = F.inline(F.array(*[F.struct(F.lit(n).alias("source"), F.col(f"__raw{i}").alias("raw"), F.col(f"__zone{i}").alias("zone")) for i, (n, _, _z) in enumerate(raws)]))
    dictionary = instant_dictionary(rows.select(entry), path)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if kind in ("string", "bigint", "double", "int")])
    # Joined by 128 bits of the key, so that the texts stay behind.
    key = lambda raw, zone: {"1": F.xxhash64(raw, zone), "2": F.xxhash64(F.lit(17), raw, zone)}
    rows = rows.withColumns({f"__k{i}{j}": h for i in range(len(raws)) for j, h in key(F.col(f"__raw{i}"), F.col(f"__zone{i}")).items()} | {f"__no{i}": F.col(f"__raw{i}").isNull() for i in range(len(raws))} | {"__spread": spread})
    rows = rows.drop(*[f"__{c}{i}" for i in range(len(raws)) for c in ("raw", "zone")])
    found = []
    for i, (name, _, _z) in enumerate(raws):
        d = dictionary.where(F.col("source") == name).select(*[h.alias(f"__d{j}") for j, h in key(F.col("raw"), F.col("zone")).items()], F.col("micros").alias(f"__m{i}"))
        # A row without a key, or that has its instant already, needs no entry: it is spread, and matches none.
        idle = F.col(f"__no{i}") | F.coalesce(*found, F.lit(None).cast("bigint")).isNotNull()
        rows = rows.withColumns({"__j1": F.when(idle, F.col("__spread")).otherwise(F.col(f"__k{i}1")), "__j2": F.when(~idle, F.col(f"__k{i}2"))})
        rows = rows.join(d, (F.col("__j1") == F.col("__d1")) & (F.col("__j2") == F.col("__d2")), "left").drop("__d1", "__d2", "__j1", "__j2")
        found.append(F.col(f"__m{i}"))
    rows = rows.withColumn(out, F.coalesce(*found))
    return rows.drop("__spread", *[f"__{c}" for i in range(len(raws)) for c in (f"k{i}1", f"k{i}2", f"no{i}", f"m{i}")])
