"""Trace texts as tables: fields by pattern, header lines carried down to the rows below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.operators.scan import WIDTH, before, carry, in_ranges, inside, upto


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 0, line). A file is one row until its lines are numbered, so that the order is the file's own."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = texts.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return lines.where("line != ''").select("file", F.col("line_no").cast("long"), "line")


def extract(lines: DataFrame, pattern: str, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines that match, with their groups in the order of ``fields`` cast to the types given; a group that is empty gives null. Columns in ``keep`` go along."""
    found = lines.where(F.col("line").rlike(pattern))
    group = lambda i: F.nullif(F.regexp_extract("line", pattern, i), F.lit(""))
    cast = lambda c, kind: F.conv(c, 16, 10).cast("long") if kind == "hex" else c.cast(kind)
    return found.select("file", "line_no", *keep, *[cast(group(i), kind).alias(name) for i, (name, kind) in enumerate(fields.items(), 1)])


def with_headers(lines: DataFrame, headers: dict[str, str], width: int = WIDTH) -> DataFrame:
    """Each name of ``headers`` as a column: the integer that its pattern's group last found at or above the line. Ranges of lines hand it on, so no task holds a file's lines."""
    value = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit("")).cast("long")
    step = in_ranges(lines.select("*", *[value(p).alias(name) for name, p in headers.items()]), ["file"], "line_no", width)
    latest = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias(f"_l_{name}") for name in headers]
    step = carry(step, ["file"], latest, lambda w: [F.last(f"_l_{name}", ignorenulls=True).over(before(w)).alias(f"_b_{name}") for name in headers])
    here = lambda name: F.last(name, ignorenulls=True).over(upto(inside("line_no")))
    return step.select(*lines.columns, *[F.coalesce(here(name), f"_b_{name}").alias(name) for name in headers])


def extract_below(lines: DataFrame, headers: dict[str, str], pattern: str, fields: dict[str, str]) -> DataFrame:
    """extract() with the header values in force at each line."""
    return extract(with_headers(lines, headers), pattern, fields, keep=tuple(headers))


def frame_infos(lines: DataFrame) -> DataFrame:
    """(file, n, is_key, type, mean, stdev of luma) from lines of a frame-information filter."""
    pattern = r"\bn:\s*(\d+).*?\biskey:(\d).*?\btype:(\w).*?\bmean:\[(\d+(?:\.\d+)?).*?\bstdev:\[(\d+(?:\.\d+)?)"
    found = extract(lines, pattern, {"n": "long", "is_key": "int", "type": "string", "mean": "double", "stdev": "double"})
    return found.withColumn("is_key", F.col("is_key") == 1).drop("line_no")


def normal_poc(poc: Column) -> Column:
    """A picture order printed as 16 unsigned bits, with its sign."""
    return F.when(poc >= 32768, poc - 65536).otherwise(poc)


#: Fields of the rows that comparators read: plain numbers, pairs in braces, lists in brackets and, for some, decoder states (low/range), each after its name and an equals sign.
ROWS = {
    "direct": (["mb", "frame", "poc", "colpoc", "colframe", "spatial", "mb_type", "ref0", "ref1", "sub0", "sub1", "sub2", "sub3"], ["mv0", "mv1", "submv0", "submv1", "submv2", "submv3"], []),
    "bidi": (["mb", "frame", "poc", "type", "mb_type", "ref0", "ref1", "ref0p1", "ref1p1", "sub0", "sub1", "sub2", "sub3"], ["mv0", "mv1", "mv0p1", "mv1p1", "submv0", "submv1", "submv2", "submv3"], []),
    "partition": (["mb", "frame", "poc", "part", "list"], ["amvd", "mvd", "mvp", "final"], []),
    "raw_partition": (["mb", "frame", "poc", "part", "list"], ["amvd", "mvd"], [], ["pre", "post"]),
    "wide_partition": (["mb", "poc"], [f"{n}{w}{p}" for n in ("mv", "amvd", "mvd", "mvp") for w in (0, 1) for p in ("", "p1")], []),
    "state": (["mb", "frame", "poc", "low", "range"], [], []),
    "colocated": (["mb", "mbx", "mby", "poc", "curpoc", "colpoc", "i8", "i4", "part", "colref0", "zero", "ref0", "ref1", "is_b8x8", "sub_type", "mb_type"], ["colmv", "mv0", "mv1"], []),
    "saved": (["frame", "poc", "mb", "part", "mbtype", "ref0"], ["mv0"], []),
    "written": (["mb", "poc", "type", "part", "ref0"], ["mv0", "sub0"], []),
    "modes": (["mb", "blk", "b8", "x", "y", "pred", "mode"], [], ["i4mode", "i4pred", "i4final", "i8left", "i8top", "i8pred", "i8mode", "stored"]),
    "reconstruction": (["frame", "mb", "blk", "b8", "x", "y", "mode", "syntax_mode", "recon_mode", "predsum", "outsum"], [], ["top_right", "right", "block_out", "pred_block", "res_block"]),
}


def labelled_rows(lines: DataFrame, label: str, kind: str) -> DataFrame:
    """Lines that hold ``label`` as a word, with the fields of ``ROWS[kind]``: numbers as long, pairs and lists as arrays; null where a line lacks one.

    Fields are found by name, in any order. true and false are 1 and 0.
    """
    numbers, pairs, lists, *states = ROWS[kind]
    value = lambda name, pattern: F.nullif(F.regexp_extract("line", rf"(?:^|\s){name}={pattern}", 1), F.lit(""))
    number = lambda name: F.coalesce(value(name, r"(-?\d+)").cast("long"), value(name, "(true|false)").cast("boolean").cast("long")).alias(name)
    array = lambda text, name: F.transform(F.split(F.trim(text), r"[,\s]+"), lambda v: v.cast("long")).alias(name)
    parts = [value(n, pattern).cast("long").alias(f"{n}_{part}") for n in (states[0] if states else []) for part, pattern in (("low", r"(\d+)/\d+"), ("range", r"\d+/(\d+)"))]
    found = lines.where(F.col("line").rlike(rf"(?:^|\s){label}(?:\s|$)"))
    return found.select("file", "line_no", *map(number, numbers), *[array(value(n, r"\{([^}]*)\}"), n) for n in pairs], *[array(value(n, r"\[([^\]]*)\]"), n) for n in lists], *parts, F.nullif(F.regexp_extract("line", r"\bkind=(\w+)", 1), F.lit("")).alias("kind"))


def motion_blocks(lines: DataFrame) -> DataFrame:
    """(file, line_no, frame, mb_x, mb_y, w, h, mvx, mvy) of exported motion vectors with a scale, by the macroblock of their target's centre.

    A target left of or above the first macroblock is left out.
    """
    fields = {"dst_x": "long", "dst_y": "long", "w": "long", "h": "long", "mvx": "long", "mvy": "long", "scale": "long"}
    found = extract_below(lines, {"frame": r"^frame=(\d+)"}, r"mv dst=\((-?\d+),(-?\d+)\) size=(\d+)x(\d+) .*motion=\((-?\d+),(-?\d+)\)/(\d+)", fields)
    block = lambda at: ((F.col(at) - 8) / 16).cast("long")  # noqa: E731  casts truncate toward zero
    placed = found.where("scale != 0").withColumn("mb_x", block("dst_x")).withColumn("mb_y", block("dst_y")).where("mb_x >= 0 and mb_y >= 0")
    return placed.select("file", "line_no", "frame", "mb_x", "mb_y", "w", "h", "mvx", "mvy")
