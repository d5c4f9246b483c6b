"""Repair of conversations whose turns do not alternate, at least cost, by auction shortest paths.

Rows are dealt by ranges of (conversation, turn, role, text's hash) and written once in that order, so a conversation of any length is
spread over parts. What meets for a whole conversation is one letter per row (its role's initial and its fault), as long as the
conversation's own ``audit``; ``auction_path`` works through these letters in blocks. The edits return to the rows cut by part: a part's
edits stand in front of its rows in sorted order and are applied row by row, so no conversation's texts are held.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import auction_path as ap, tables

SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
SUMMARY = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<part:int,edits:string,state:int>>"
REPAIRED = "conv_id long, part int, at long, edit string, role string, text string"
DIGEST = "conv_id long, repaired_sha256 string"


def as_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text; a null role or text is one space. Other columns are left out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows as op13 damages them, by the CRC-32 of ``conv_id:turn`` modulo 20."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("_")).drop("_")


def placed(turns: DataFrame, rows_per_part: int = 50_000, bytes_per_part: int = 32 << 20) -> DataFrame:
    """The turns with their place (part int, at long) in order of conversation, turn (nulls first), role and text's hash, as a written table."""
    n, size = turns.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    marked = turns.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = ["conv_id", "turn", "role", "digest"]
    # A row's copies are equal in all keys; they stay in one part, where their letters take a byte each.
    dealt = marked.repartitionByRange(max(tables.parts(n, rows_per_part), tables.parts(size, bytes_per_part)), *keys).sortWithinPartitions(*keys)
    return tables.stage(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("at", 33).cast("int")), "turns")


def letters(turns: DataFrame) -> DataFrame:
    """(conv_id, part, codes): a letter for each of the conversation's rows in that part, in order; ``turns`` are ``placed``."""
    first = turns.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(False).alias("again"))
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.coalesce(*(F.when(F.col("role").startswith(c), i) for i, c in enumerate(ap.INITIALS)), F.lit(ap.OTHER))
    own = F.when(bare == "", ap.BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), ap.FINE).otherwise(ap.TRUNCATED)
    narrow = turns.select("conv_id", "part", "at", initial.alias("initial"), own.alias("own")).join(first, "at", "left")
    fault = F.when(F.col("own") == ap.BLANK, ap.BLANK).when(F.col("again").isNull(), ap.DUPLICATE).otherwise(F.col("own"))
    code = F.char((65 + 4 * F.col("initial") + fault).cast("int"))
    in_order = F.array_sort(F.collect_list(F.struct("at", code.alias("code"))))
    return narrow.groupBy("conv_id", "part").agg(F.array_join(F.transform(in_order, lambda x: x["code"]), "").alias("codes"))


def _pieces(audit: str, codes: list[str]) -> list[tuple[str, int]]:
    """The edits of each part's rows with what has been said before them; insertions belong to the row behind, the last ones to the last part."""
    out, at, state = [], 0, ap.START
    for k, rows in enumerate(codes):
        start, entered, left = at, state, len(rows)
        while left or (k == len(codes) - 1 and at < len(audit)):
            name = audit[at]
            if name != "I":
                left -= 1
            if name != "D":
                code = ord(rows[len(rows) - left - 1]) - 65 if name == "K" else 0
                state = ap.FOLLOWS[state][ap.INITIALS[code // 4] if name == "K" else ap.TURN[state]]
            at += 1
        out.append((audit[start:at], entered))
    return out


def edits(codes: DataFrame) -> DataFrame:
    """Faults, cost and edits (SUMMARY) of each conversation of ``letters``."""
    legal = {a + b for a, b in ("su", "ua", "au")}

    def emit(batches):
        held: list[tuple] = []

        def solved(groups):
            rows = []
            for conv, parts, pieces in groups:
                every = "".join(pieces)
                cost, audit = ap.repair(every)
                fault = [(ord(c) - 65) % 4 for c in every]
                roles = "".join((ap.INITIALS + "-")[(ord(c) - 65) // 4] for c in every)
                illegal = sum(roles[i : i + 2] not in legal for i in range(len(roles) - 1))
                cut = [{"part": p, "edits": e, "state": s} for p, (e, s) in zip(parts, _pieces(audit, pieces))]
                rows.append((conv, *(fault.count(x) for x in (ap.BLANK, ap.DUPLICATE, ap.TRUNCATED)), illegal, cost, audit, cut))
            kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("part", pa.int32()), ("edits", pa.string()), ("state", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SUMMARY.split(", ", 7)])

        for batch in batches:
            for conv, part, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] == conv:
                    held[-1][1].append(part)
                    held[-1][2].append(piece)
                    continue
                if len(held) >= 2000:
                    yield solved(held)
                    held = []
                held.append((conv, [part], [piece]))
        if held:
            yield solved(held)

    return codes.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(emit, SUMMARY)


def apply_edits(turns: DataFrame, summary: DataFrame, *by: str) -> DataFrame:
    """(conv_id, part, at, edit, role, text) of the repaired conversations in order; ``by`` are the columns that deal out the work.

    ``edit`` is I, K or R; deleted rows are absent, an inserted turn has the ``at`` of the row behind it.
    """
    none = lambda kind: F.lit(None).cast(kind)
    pieces = summary.select("conv_id", F.explode("pieces").alias("p")).select(
        "conv_id", "p.part", F.lit(-1).cast("long").alias("at"), none("string").alias("role"), none("string").alias("text"), "p.edits", "p.state")
    rows = turns.select("conv_id", "part", "at", "role", "text", none("string").alias("edits"), none("int").alias("state"))

    def emit(batches):
        names = [c.split()[0] for c in REPAIRED.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        plan, step, state = "", 0, ap.START

        for batch in batches:
            out = []
            for conv, part, at, role, text, found, entered in zip(*(c.to_pylist() for c in batch.columns)):
                if at < 0:
                    plan, step, state = found, 0, entered
                    continue
                while True:
                    name = plan[step]
                    step += 1
                    turn = role[:1] if name == "K" else ap.TURN[state]
                    if name != "D":
                        out.append((conv, part, at, name, role if name == "K" else ROLES[turn], "" if name == "I" else text))
                        state = ap.FOLLOWS[state][turn]
                    if name != "I":
                        break
                if 0 < len(plan) - step <= 2 and not plan[step:].strip("I"):  # what ends the conversation
                    for _ in plan[step:]:
                        out.append((conv, part, at, "I", ROLES[ap.TURN[state]], ""))
                        state = ap.FOLLOWS[state][ap.TURN[state]]
                    step = len(plan)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)

    return pieces.unionByName(rows).repartition(*by).sortWithinPartitions("conv_id", "part", "at").mapInArrow(emit, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 over ``role:text`` joined by newlines, for each conversation; ``repaired`` is ``apply_edits`` dealt by conv_id."""
    def emit(batches):
        conv, hashed = None, None

        def row(conv, hashed):
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([hashed.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            ids, roles, texts = (batch.column(i).to_pylist() for i in (0, 4, 5))
            for c, role, text in zip(ids, roles, texts):
                if hashed is None or c != conv:
                    if hashed is not None:
                        yield row(conv, hashed)
                    conv, hashed = c, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
        if hashed is not None:
            yield row(conv, hashed)

    return repaired.mapInArrow(emit, DIGEST)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Least-cost edits of all conversations of a table (conv_id, turn, role, text).

    Gives the placed turns; per conversation blank, duplicate, truncated, illegal, cost and audit; and the repaired rows. A conversation
    reads ``(s?(ua)+)?`` in its roles' initials afterwards. Rows stand by turn, nulls first; rows of one turn by role, then by the hash of the
    text. A null role or text is one space; an empty or other role can be changed or deleted only. Repeated rows are duplicates; rows
    with a null conv_id make one conversation. Very long texts are never held together. An empty table gives empty results; other
    columns are ignored.
    """
    turns = placed(as_turns(rows))
    summary = tables.stage(edits(letters(turns)), "edits")
    return turns, summary, apply_edits(turns, summary, "conv_id", "part")


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers between the least and the greatest that no row has."""
    wide = lambda c: c.cast("decimal(38,0)")
    missing = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).alias("_g")).select("conv_id", F.col("_g").try_cast("long").alias("gaps"))


def audited(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """Every conv_id of ``rows`` with gaps, faults, cost, audit and repaired_sha256 of its ``damaged`` rows; zeros where none is left.

    ``gaps`` is null only where turn numbers lie further apart than a long can say.
    """
    turns, summary, _ = repair(damaged)
    hashed = digests(apply_edits(turns, summary, "conv_id"))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (gaps(turns).withColumn("_left", F.lit(True)), summary.drop("pieces"), hashed):
        part = part.withColumnRenamed("conv_id", "_c")
        out = out.join(part, out.conv_id.eqNullSafe(part["_c"]), "left").drop("_c")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("conv_id", F.when(F.col("_left").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps"),
                      *(zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``conversations``, damaged as the contract says."""
    rows = as_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return audited(rows, damage(rows))
