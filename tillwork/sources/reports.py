"""Report files to typed tables. Input of each parser: placed lines of its files (see :mod:`lines`)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rules, scalar as S
from ..operators import tables as T
from ..session import stage
from . import lines as L


def _contains(text: str) -> Column:
    return F.lower("line").contains(text)


def _after(cell: Column, prefix: str) -> Column:
    return S.strip(F.regexp_replace(cell, prefix, ""))


def _data_lines(lines: DataFrame, dates: bool = True) -> DataFrame:
    """Cells of the lines that are not noise and, unless the report's rows carry dates, not date lines."""
    kept = L.classify(lines).where(~F.col("is_noise"))
    if dates:
        kept = kept.where(~F.col("is_date_line"))
    return L.split_cells(kept)


# ---------------------------------------------------------------- parsers

def monthly_sales(lines: DataFrame) -> DataFrame:
    """branch, month, year, month_num, date, revenue; rows of year 0 are dropped."""
    df = _data_lines(lines).where(~F.col("line").rlike(r"(?i)^Month\s*,"))
    prefix = r"(?i)^Branch\s*Name\s*:\s*"
    header = F.coalesce(F.col("c0").rlike(prefix), F.lit(False))
    df = L.carry(df, {"branch": (header, _after(F.col("c0"), prefix))})
    rows = df.where(~header & ~F.col("is_total") & ~L.is_label() & F.col("branch").isNotNull() & (F.col("n_cells") >= 4))
    number = S.month_number(F.col("c0"))
    year, revenue = S.parse_number(F.col("c2")), S.parse_number(F.col("c3"))
    return (rows.select("branch", F.col("c0").alias("month"), year.cast("int").alias("year"), number.alias("month_num"), revenue.alias("revenue"))
            .where(F.col("month_num").isNotNull() & (F.col("year") != 0) & F.col("revenue").isNotNull())
            .withColumn("date", F.make_date("year", "month_num", F.lit(1))))


def avg_sales_menu(lines: DataFrame) -> DataFrame:
    """branch, channel, customers, sales, avg_per_customer; a label line names the branch."""
    df = _data_lines(lines).where(~F.col("line").rlike(r"(?i)^Menu Name\s*,") & ~F.col("is_total"))
    df = df.where(~F.lower(F.coalesce("c0", F.lit(""))).contains("average sales") & ~_contains("year:"))
    df = L.carry(df, {"branch": (L.is_label(), F.col("c0"))})
    customers, sales, average = (S.parse_number(F.col(c)) for c in ("c1", "c2", "c3"))
    rows = df.where(F.col("branch").isNotNull() & F.col("c0").rlike(r"(?i)^(DELIVERY|TABLE|TAKE\s*AWAY)$") & (F.col("n_cells") >= 4))
    fallback = F.when(customers > 0, sales / customers).otherwise(0.0)
    return rows.select("branch", F.upper("c0").alias("channel"), customers.alias("customers"), sales.alias("sales"),
                       F.when(average != 0, average).otherwise(fallback).alias("avg_per_customer")).where(
        F.col("customers").isNotNull() & F.col("sales").isNotNull())


def items_by_group(lines: DataFrame) -> DataFrame:
    """branch, division, group, item, qty, amount under three header levels; a header clears the levels below it."""
    df = _data_lines(lines).where(~F.col("line").rlike(r"(?i)^Description\s*,\s*Barcode"))
    levels = {k: rf"(?i)^{k}\s*:\s*" for k in ("branch", "division", "group")}
    first = F.coalesce("c0", F.lit(""))
    tests = {k: first.rlike(p) for k, p in levels.items()}
    df = L.carry(df, {k: (tests[k], _after(first, p)) for k, p in levels.items()},
                 {"division": ["branch"], "group": ["branch", "division"]})
    header = tests["branch"] | tests["division"] | tests["group"]
    filled = (F.col("branch") != "") & (F.col("group") != "")
    rows = df.where(~header & ~F.col("is_total") & ~L.is_label() & filled & (F.col("n_cells") >= 4) & F.col("c0").isNotNull())
    return rows.select(*L.PLACE, "branch", F.coalesce("division", F.lit("")).alias("division"), "group", F.col("c0").alias("item"),
                       S.parse_number(F.col("c2")).alias("qty"),
                       F.coalesce(S.parse_number(F.col("c3")), F.lit(0.0)).alias("amount")).where(F.col("qty").isNotNull())


def customer_orders(lines: DataFrame, wrapped: bool = False, most_orders: int = 500) -> DataFrame:
    """branch, customer, phone, first_order, last_order, total, num_orders.

    The number of orders is the last whole number in the cells after the last time stamp. Only in a row without a time stamp it is guessed: the
    last whole number of at most ``most_orders`` between two commas, NULL if there is none. ``wrapped`` joins a row to all
    lines it wraps onto, until the next customer, branch label, noise or blank line.
    """
    if wrapped:
        lines = join_wrapped(lines)
    df = L.classify(lines).where(~F.col("is_noise"))
    df = df.where(~F.col("line").rlike(r"(?i)^Customer Name\s*,\s*Address") & ~_contains("customer orders") & ~_contains("from date:"))
    df = df.where(~_contains("total by branch"))
    person = F.regexp_extract("line", rules.PERSON, 0)
    label, first = _branch_label()
    df = L.carry(df, {"branch": (label, first)})
    rows = L.split_cells(df.where(~label & (person != "") & F.col("branch").isNotNull()))
    stamps = F.regexp_extract_all("line", F.lit(rf"({rules.STAMP})"), 1)
    phone = S.strip(F.regexp_extract("line", rules.PERSON + r"\s*,\s*[^,]*,\s*(\d[\d\s]*)", 1))
    quoted = F.regexp_extract_all("line", F.lit(r'"([\d,]+\.?\d*)"'), 1)
    stamped = F.transform("cells", lambda c: F.coalesce(c.rlike(rules.STAMP), F.lit(False)))
    last = F.size("cells") - F.array_position(F.reverse(stamped), F.lit(True)).cast("int") + 1
    after = F.filter(F.slice("cells", last + 1, F.size("cells")), lambda c: c.rlike(r"^\d+$"))
    guesses = F.transform(F.regexp_extract_all("line", F.lit(r",\s*(\d+)\s*(?=,)"), 1), lambda x: x.try_cast("int"))
    guess = F.get(F.filter(F.reverse(guesses), lambda x: x.between(1, most_orders)), F.lit(0))
    count = F.when(F.array_contains(stamped, True), F.try_element_at(after, F.lit(-1)).try_cast("int")).otherwise(guess)

    def stamp(i: int) -> Column:
        return F.try_to_timestamp(F.get(stamps, F.lit(i)), F.lit("yyyy-MM-dd HH:mm"))

    return rows.select("branch", person.alias("customer"), phone.alias("phone"), stamp(0).alias("first_order"),
                       F.when(F.size(stamps) > 1, stamp(1)).otherwise(stamp(0)).alias("last_order"),
                       F.coalesce(S.parse_number(F.get(quoted, F.lit(0))), F.lit(0.0)).alias("total"), count.alias("num_orders"))


def _branch_label() -> tuple[Column, Column]:
    """Whether a line names a branch (text in its first cell only, no customer), and the name."""
    first = S.strip(F.split("line", ",")[0])
    rest = S.strip(F.translate(F.regexp_replace("line", "^[^,]*", ""), ",", ""))
    return (rest == "") & first.rlike(r"^[A-Z][A-Za-z\s\-']+$") & ~F.col("line").rlike(rules.PERSON), first


def join_wrapped(lines: DataFrame) -> DataFrame:
    """Customer rows joined with the lines they wrap onto, until the next customer, branch label, noise or blank line."""
    starts = F.col("line").rlike(rf"^{rules.PERSON}\s*(,|$)")
    stops = F.col("is_noise") | _branch_label()[0]
    df = L.carry(L.classify(lines), {"_open": (starts | stops, starts)}, counts={"_row": starts})
    open_ = F.coalesce("_open", F.lit(False))
    at = F.struct("block", "pos")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "line"))), lambda x: x["line"])
    kept = [c for c in lines.columns if c not in ("path", "line")]
    rows = df.where(open_).groupBy("path", "_row").agg(F.min(F.struct(at.alias("at"), *kept)).alias("_first"), F.concat_ws(",", parts).alias("line"))
    rows = rows.select("path", *[F.col(f"_first.{c}").alias(c) for c in kept], "line")
    return df.where(~open_).select("path", *kept, "line").unionByName(rows).select(*lines.columns)


def transaction_baskets(lines: DataFrame) -> DataFrame:
    """Order-detail lines: file, basket_id, branch, customer, item, qty, price and place.

    Each person header starts a new basket; a branch header does not end the person's block.
    """
    df = _data_lines(lines).where(~F.col("line").rlike(r"(?i)^Full Name\s*,\s*Qty") & ~_contains("sales by customer"))
    first = F.coalesce("c0", F.lit(""))
    branch_prefix = r"(?i)^Branch\s*:\s*"
    branch = first.rlike(branch_prefix + ".+")
    person = first.rlike(f"^{rules.PERSON}") & ~branch & ~F.col("is_total")
    name = F.regexp_replace(_after(first, branch_prefix), ",+$", "")
    # Lines are stored once classified, as carrying reads them twice; only the line moves to its block, its cells are taken behind the headers.
    df = stage(df.select(*L.PLACE, "file", "line", "is_total", "c0"), "detail_lines")
    df = L.carry(df, {"branch": (branch, name), "customer": (person, first)}, counts={"basket_id": person})
    df = df.where(~branch & ~person & ~F.col("is_total") & F.col("c0").isNull() & F.col("branch").isNotNull() & F.col("customer").isNotNull())
    # The cells are the output of a generator: a filter on them is not pushed down to take them a second time.
    cells = F.inline(F.array(F.struct("n_cells", *[F.col(f"c{i}").alias(f"_c{i}") for i in (1, 2, 3)])))
    rows = L.split_cells(df).select(*L.PLACE, "file", "basket_id", "branch", "customer", cells)
    rows = rows.where((F.col("n_cells") >= 4) & F.col("_c2").isNotNull())
    numbers = F.inline(F.array(F.struct(S.parse_number(F.col("_c1")).alias("qty"), F.coalesce(S.parse_number(F.col("_c3")), F.lit(0.0)).alias("price"))))
    return rows.select(*L.PLACE, "file", "basket_id", "branch", "customer", F.col("_c2").alias("item"), numbers).where(F.col("qty").isNotNull())


def attendance(lines: DataFrame) -> DataFrame:
    """emp_id, name, branch, date, punch_in, punch_out, duration_hours.

    Branch names are the texts on the lines right after an employee header; any later line with such a cell sets the branch.
    """
    df = L.split_cells(L.classify(lines))
    employee = F.col("line").rlike(rules.EMPLOYEE)
    df = L.previous(df, employee, "_after_employee")
    cells = F.array_compact("cells")
    plain = F.filter(cells, lambda c: ~c.rlike("^" + rules.PUNCH_DATE) & ~c.rlike("^" + rules.PUNCH_TIME) & ~c.rlike(r"^\d[\d.]*$"))
    names = (df.where(F.coalesce("_after_employee", F.lit(False)) & ~employee)
             .select("path", F.get(plain, F.lit(0)).alias("_name")).where(F.col("_name").isNotNull()).distinct())
    skip = (F.col("is_noise") | F.col("is_total") | _contains("time & attendance") | _contains("punch in") | _contains("from date:"))
    df = df.where(~skip)
    header = employee & F.col("line").rlike(rules.EMPLOYEE_NAME)
    has_time = F.col("line").rlike(rules.PUNCH_TIME)
    # Only lines without a punch can name a branch; their cells are looked up in the file's names.
    labels = (df.where(~header & ~has_time).select(*L.PLACE, F.posexplode(cells).alias("_i", "_name")).join(names, ["path", "_name"])
              .groupBy(*L.PLACE).agg(F.min_by("_name", "_i").alias("_label")))
    df = df.join(labels, L.PLACE, "left")
    emp = F.replace(F.regexp_extract("line", rules.EMPLOYEE, 1), F.lit(".0"), F.lit(""))
    df = L.carry(df, {"emp_id": (header, emp), "name": (header, F.regexp_extract("line", rules.EMPLOYEE_NAME, 1)),
                      "branch": (F.col("_label").isNotNull(), F.col("_label"))})
    dates = F.regexp_extract_all("line", F.lit(rules.PUNCH_DATE), 1)
    times = F.regexp_extract_all("line", F.lit(rules.PUNCH_TIME), 1)
    rows = df.where(~header & (F.size(dates) > 0) & (F.size(times) > 0) & F.col("emp_id").isNotNull())
    third, second = F.get(times, F.lit(2)), F.get(times, F.lit(1))
    length = F.when(third.isNotNull(), third).when((F.size(times) == 2) & (F.size(dates) == 1), second)
    return rows.select("emp_id", "name", "branch", F.to_date(F.try_to_timestamp(F.get(dates, F.lit(0)), F.lit("dd-MMM-yy"))).alias("date"),
                       F.replace(F.get(times, F.lit(0)), F.lit("."), F.lit(":")).alias("punch_in"),
                       F.replace(second, F.lit("."), F.lit(":")).alias("punch_out"), S.duration_hours(length).alias("duration_hours"))


def attendance_hours(lines: DataFrame, names: Sequence[tuple[str, str]], shortest: float = 0.1) -> DataFrame:
    """branch_raw, branch, emp_id, duration_hours: the duration at the end of a line, clock glitches left out."""
    df = L.classify(lines).where(~F.col("is_noise"))
    df = df.where(~_contains("time & attendance") & ~_contains("punch in") & ~_contains("from date:")).select(*L.PLACE, "line")
    header = F.col("line").rlike(rules.EMPLOYEE) | F.col("line").rlike(rules.EMPLOYEE_NAME)
    df = L.split_cells(L.previous(df, header, "_after"))  # a task holds the lines of a block, so no cells go along with them
    cells = F.array_compact("cells")
    label = F.get(F.filter(cells, lambda c: c.rlike(r"^[A-Za-z][A-Za-z0-9\s\-'()]+$")), F.lit(0))
    naming = F.coalesce("_after", F.lit(False)) & ~header
    df = df.select(*L.PLACE, "line", "_after", F.when(naming, label).alias("_label"))
    known = naming & S.canonical_name(F.col("_label"), names).isNotNull()
    emp = F.regexp_extract("line", rules.EMPLOYEE, 1)
    df = L.carry(df, {"emp_id": (F.col("line").rlike(rules.EMPLOYEE), emp), "branch_raw": (known, F.col("_label"))})
    hours = S.duration_hours(F.regexp_extract("line", r"(\d{2}[.:]\d{2}[.:]\d{2})\s*$", 1))
    return (df.where(~header & ~naming & F.col("emp_id").isNotNull() & F.col("branch_raw").isNotNull())
            .select("branch_raw", S.canonical_name(F.col("branch_raw"), names).alias("branch"), "emp_id", hours.alias("duration_hours"))
            .where(F.col("duration_hours") > shortest))


def tax_summary(lines: DataFrame, names: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """branch_raw, branch, vat, total_tax: first and last number of each "Total By Branch" line."""
    df = _data_lines(lines)
    df = df.where(~_contains("tax report") & ~_contains("tax description") & ~F.substring(F.lower("line"), 1, 20).contains("vat"))
    prefix = r"(?i)^Branch\s*Name\s*:\s*"
    header = F.coalesce(F.col("c0").rlike(prefix), F.lit(False))
    df = L.carry(df, {"branch_raw": (header, _after(F.col("c0"), prefix))})
    numbers = F.array_compact(F.transform("cells", S.parse_number))
    rows = df.where(~header & _contains("total by branch") & F.col("branch_raw").isNotNull()).withColumn("_n", numbers).where(F.size("_n") > 0)
    return _canonical(rows.select("branch_raw", F.get("_n", F.lit(0)).alias("vat"), F.element_at("_n", -1).alias("total_tax")), names)


def delivery_detail(lines: DataFrame, names: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """branch_raw, branch, customer, item, qty, price with qty > 0 and price > 0; a new branch clears the customer."""
    df = _data_lines(lines).where(~F.col("is_total") & ~F.col("line").rlike(r"(?i)^Full Name\s*,"))
    df = df.where(~_contains("sales by customer") & ~_contains("from date:"))
    first = F.coalesce("c0", F.lit(""))
    prefix = r"(?i)^Branch\s*[:\s]\s*"
    branch = first.rlike(prefix + ".+")
    person = first.rlike(f"^{rules.PERSON}") & ~branch
    # Only the line moves to its block; its cells are taken behind the headers.
    df = L.carry(df.select(*L.PLACE, "line", "c0"), {"branch_raw": (branch, _after(first, prefix)), "customer": (person, first)}, {"customer": ["branch_raw"]})
    df = df.where(F.col("c0").isNull() & F.col("branch_raw").isNotNull() & F.col("customer").isNotNull())
    cells = F.inline(F.array(F.struct(*[F.col(f"c{i}").alias(f"_c{i}") for i in (1, 2, 3)])))
    rows = L.split_cells(df).select("branch_raw", "customer", cells).where(F.col("_c2").isNotNull())
    numbers = F.inline(F.array(F.struct(S.parse_number(F.col("_c1")).alias("qty"), S.parse_number(F.col("_c3")).alias("price"))))
    rows = rows.select("branch_raw", "customer", F.col("_c2").alias("item"), numbers).where((F.col("qty") > 0) & (F.col("price") > 0))
    return _canonical(rows, names)


def _canonical(rows: DataFrame, names: Sequence[tuple[str, str]] | None) -> DataFrame:
    """Add the canonical branch; rows of branches outside ``names`` are dropped."""
    branch = F.col("branch_raw") if names is None else S.canonical_name(F.col("branch_raw"), names)
    rest = [c for c in rows.columns if c != "branch_raw"]
    return rows.withColumn("branch", branch).where(F.col("branch").isNotNull()).select("branch_raw", "branch", *rest)


# ---------------------------------------------------------------- registry and routing

@dataclass(frozen=True)
class ReportSpec:
    """A report type: text that detects it, text its parser asks for, and the parser (lines -> table)."""

    name: str
    detect: str
    require: str
    parse: Callable[[DataFrame], DataFrame]


_PARSERS = {"monthly_sales": monthly_sales, "items_by_group": items_by_group, "avg_sales_menu": avg_sales_menu,
            "customer_orders": customer_orders, "transaction_baskets": transaction_baskets, "attendance": attendance}
REGISTRY = tuple(ReportSpec(name, sig, rules.PARSER_SIGNATURES[name], _PARSERS[name]) for sig, name in rules.REPORT_SIGNATURES)


def head_text() -> Column:
    """First lines in lower case; a line break never lets a signature match across lines."""
    return F.lower(F.array_join("head", "\n "))


def detect_type(text: Column, registry: Sequence[ReportSpec] = REGISTRY) -> Column:
    """First report type, in registry order, whose signature occurs."""
    return F.coalesce(*[F.when(text.contains(s.detect), F.lit(s.name)) for s in registry])


def audit_files(lines: DataFrame, registry: Sequence[ReportSpec] = REGISTRY, seen: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """One row per file: file, path, hash, report_type, status (parsed or skipped) and reason.

    Of files with the same content the first by name is kept. ``seen`` (hash, file) holds files of earlier runs. Files without a
    line have no row in ``lines``; ``listed`` (path, file), see ``lines.list_files``, adds them as empty.
    """
    hashes = L.fingerprints(lines)
    first = hashes.groupBy("hash").agg(F.min_by(F.struct("path", "file"), F.struct("file", "path")).alias("_first"))
    files = hashes.join(first, "hash").join(L.first_lines(lines).select("path", "head"), "path", "left")
    twin = F.when(F.col("_first.path") != F.col("path"), F.col("_first.file"))
    if seen is not None:
        earlier = seen.groupBy("hash").agg(F.min("file").alias("_seen"))
        files = files.join(earlier, "hash", "left")
        twin = F.coalesce("_seen", twin)
    text = head_text()
    kind = detect_type(text, registry)
    fits = F.coalesce(*[F.when(kind == s.name, text.contains(s.require)) for s in registry])
    reason = (F.when(twin.isNotNull(), F.concat(F.lit("duplicate of "), twin)).when(kind.isNull(), F.lit("unknown report type"))
              .when(~fits, F.concat(F.lit("signature missing for "), kind)))
    audit = files.select("file", "path", "hash", F.when(twin.isNull(), kind).alias("report_type"),
                         F.when(reason.isNull(), "parsed").otherwise("skipped").alias("status"), reason.alias("reason"))
    if listed is None:
        return audit
    key = lambda c: F.regexp_replace(c, ":/+", ":/").alias("_key")  # noqa: E731  the index and the metadata write local paths differently
    empty = listed.withColumn("_key", key("path")).join(audit.select(key("path")), "_key", "left_anti")
    none = F.lit(None).cast("string")
    return audit.unionByName(empty.select("file", "path", none.alias("hash"), none.alias("report_type"), F.lit("skipped").alias("status"), F.lit("empty").alias("reason")))


def parse_all(lines: DataFrame, audit: DataFrame, registry: Sequence[ReportSpec] = REGISTRY) -> dict[str, DataFrame]:
    """Route the lines of each accepted file to its parser; one table per report type.

    ``lines`` is read once per type: pass a stored table (see ``plans.flows.etl``), partitioned by report type.
    """
    if "report_type" not in lines.columns:
        accepted = audit.where("status = 'parsed'").select("path", "report_type")
        lines = lines.join(accepted, "path")
    return {s.name: s.parse(lines.where(F.col("report_type") == s.name)) for s in registry}


def clean_tables(parsed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Add the derived columns to the parsed tables; transaction_baskets becomes raw, audit and core tables."""
    out: dict[str, DataFrame] = {}
    derive = {"monthly_sales": T.flag_partial_history, "avg_sales_menu": T.channel_shares, "customer_orders": T.derive_customers,
              "items_by_group": lambda d: T.rank_items(T.tag_items(d)), "attendance": T.flag_shifts}
    for name, df in parsed.items():
        if name == "transaction_baskets":
            out["transaction_baskets_raw_lines"] = df
            out["transaction_baskets_audit_lines"] = T.flag_lines(df)
            out["transaction_baskets_basket_core"] = T.basket_core(T.flag_lines(df), ("block", "pos"))
        else:
            out[name] = derive.get(name, lambda d: d)(df)
    return out


def load_named_sources(spark: SparkSession, path: str, names: Sequence[tuple[str, str]], files: Mapping[str, str] = rules.SOURCE_FILES) -> dict[str, DataFrame]:
    """Sources recognised by file name, the first file by name for each source; absent sources are absent from the dict.

    A folder of parts, as Spark writes one, counts as one file of its name; large sources are written and read that way.
    """
    raw = L.scan(spark.read, path)
    parts = {p: L.scan_parts(spark, p, name) for name, p in L.folders(spark, path).items() if name.lower() in files}
    names_of = [df.select("path", "file").distinct() for df in (raw, *parts.values())]
    key = S.lookup(F.lower("file"), files)
    chosen = (reduce(DataFrame.unionByName, names_of).withColumn("source", key).where(F.col("source").isNotNull())
              .groupBy("source").agg(F.min_by("path", F.struct("file", "path")).alias("path")))
    found = {r.source: r.path for r in chosen.collect()}  # at most one row per known source

    def of(source: str) -> DataFrame:
        at = found[source]
        with L.block_bytes(spark):  # blocks are those of this reading, as the lines are written with them
            return stage(L.decode(parts[at] if at in parts else L.place(raw.where(F.col("path") == at))).drop("bytes"), source)

    def branch_of(df: DataFrame) -> DataFrame:
        return _canonical(df.withColumnRenamed("branch", "branch_raw"), names)

    make = {"monthly_sales": lambda d: branch_of(monthly_sales(d)),
            "customer_orders": lambda d: branch_of(customer_orders(d, wrapped=True)).where("total > 0"),
            "tax_summary": lambda d: tax_summary(d, names), "attendance": lambda d: attendance_hours(d, names),
            "delivery_detail": lambda d: delivery_detail(d, names)}
    return {s: make[s](of(s)) for s in make if s in found}
