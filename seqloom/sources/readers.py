"""Text formats as DataFrames. All reading is Spark's, so any store and codec that Spark knows will do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import sequence as S


def _lines(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path)


def _fields(lines: DataFrame, names: list[str], separator: str = "\t", comment: str | None = "#") -> DataFrame:
    rows = lines.filter(F.length("value") > 0)
    if comment:
        rows = rows.filter(~F.col("value").startswith(comment))
    parts = F.split("value", separator, -1)
    return rows.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, line, value)`` with line numbers from 0 in each file, without one task for a file.

    A file's blocks are read apart. Lines of a block keep their order, so each gets its place in the
    block; how many lines a block has is counted first, and a running sum over blocks, a few rows a
    file, gives each block its first number.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for batch in batches:
            places = []
            for now in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now != key:
                    key, n = now, 0
                places.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["value", "file", "block", "place"])

    placed = raw.mapInArrow(place, "value string, file string, block long, place long")
    from pyspark.sql import Window as W

    counted = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select(F.col("file").alias("_f"), F.col("block").alias("_b"), before.alias("before"))
    return placed.join(starts, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).select("file", (F.col("before") + F.col("place")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str | list[str], offset: int = 33, interleaved: bool = False) -> DataFrame:
    """``(id, bases, quals array<int>, numeric_id, pairnum)``: four lines a record, put together by line number."""
    lines = numbered_lines(spark, path).withColumn("record", F.floor(F.col("line") / 4)).withColumn("field", F.col("line") % 4)
    field = lambda i: F.max(F.when(F.col("field") == i, F.col("value")))
    rows = lines.groupBy("file", "record").agg(field(0).alias("id"), field(1).alias("bases"), field(3).alias("q"))
    pair = (F.col("record") % 2).cast("int") if interleaved else F.lit(0)
    number = F.floor(F.col("record") / 2) if interleaved else F.col("record")
    return rows.filter(F.col("id").startswith("@")).select(F.substring("id", 2, 1 << 30).alias("id"), "bases", S.phred(F.col("q"), offset).alias("quals"), number.cast("long").alias("numeric_id"), pair.alias("pairnum"))


def read_fastq_pair(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Twin files by position; ``mate_missing`` where one is shorter."""
    a, b = read_fastq(spark, first), read_fastq(spark, second)
    b = b.select("numeric_id", F.col("id").alias("id2"), F.col("bases").alias("bases2"), F.col("quals").alias("quals2"))
    return a.join(b, "numeric_id", "full_outer").withColumn("mate_missing", F.col("id").isNull() | F.col("id2").isNull())


def read_fasta(spark: SparkSession, path: str | list[str], least: int = 0) -> DataFrame:
    """``(id, bases)``: records split at the header mark, wrapped lines joined."""
    rows = _lines(spark, path, "\n>").select(F.regexp_replace("value", "^>|\r", "").alias("v")).filter("length(trim(v)) > 0")
    rows = rows.select(F.substring_index("v", "\n", 1).alias("id"), F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)"), r"\s", "").alias("bases"))
    return rows.filter(F.length("bases") >= least)


def read_qual(spark: SparkSession, path: str) -> DataFrame:
    """``(id, quals)``; join with FASTA by id."""
    rows = _lines(spark, path, "\n>").select(F.regexp_replace("value", "^>", "").alias("v")).filter("length(trim(v)) > 0")
    numbers = F.filter(F.split(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)"), r"\s+"), lambda x: x != "")
    return rows.select(F.substring_index("v", "\n", 1).alias("id"), F.transform(numbers, lambda x: x.cast("int")).alias("quals"))


SAM_FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The eleven fields typed, and ``tags map<string,string>`` (``NM:i`` to its value); headers left out. Coordinates stay 1-based."""
    rows = _lines(spark, path).filter((F.length("value") > 0) & ~F.col("value").rlike(r"^@[A-Z]{2}(\t|$)"))
    parts = F.split("value", "\t", -1)
    whole = {"flag", "pos", "mapq", "pnext", "tlen"}
    columns = [(F.get(parts, F.lit(i)).cast("int") if n in whole else F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(SAM_FIELDS)]
    tags = F.map_from_entries(F.transform(F.filter(F.slice(parts, 12, 1 << 20), lambda t: t.contains(":")), lambda t: F.struct(F.substring(t, F.lit(1), F.lit(4)), F.regexp_replace(t, r"^.{2}:.:", ""))))
    return rows.select(*columns, tags.alias("tags"))


def sam_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(kind, fields map)``; reference lengths are the LN of SQ."""
    rows = _lines(spark, path).filter(F.col("value").rlike(r"^@[A-Z]{2}\t"))
    return rows.select(F.substring("value", 2, 2).alias("kind"), F.expr("str_to_map(substring(value, 5), '\t', ':')").alias("fields"))


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(scaf, pos, id, ref, alt, qual, filter, info map, format, samples array)``."""
    names = ["scaf", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]
    rows = _lines(spark, path).filter((F.length("value") > 0) & ~F.col("value").startswith("#"))
    parts = F.split("value", "\t", -1)
    columns = [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]
    out = rows.select(*columns, F.slice(parts, 10, 1 << 20).alias("samples"))
    return out.withColumns({"pos": F.col("pos").cast("int"), "qual": F.col("qual").try_cast("double"), "info": F.expr("str_to_map(info, ';', '=')")})


def read_gff(spark: SparkSession, path: str | list[str], types: list[str] | None = None) -> DataFrame:
    """Nine columns and ``attributes map``; GFF3 ``a=b`` and GTF ``a "b"`` alike."""
    rows = _fields(_lines(spark, path), ["seqid", "source", "type", "start", "stop", "score", "strand", "phase", "attributes"])
    if types:
        rows = rows.filter(F.col("type").isin(types))
    plain = F.regexp_replace(F.regexp_replace("attributes", r'\s*;\s*', ";"), r'(^|;)([^=;" ]+) "([^"]*)"', "$1$2=$3")
    return rows.withColumns({"start": F.col("start").cast("int"), "stop": F.col("stop").cast("int"), "score": F.col("score").try_cast("double"), "attributes": F.str_to_map(F.regexp_replace(plain, ";$", ""), F.lit(";"), F.lit("="))})


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = _fields(_lines(spark, path).filter(~F.col("value").rlike("^(track|browser)")), ["scaf", "start", "stop"])
    return rows.withColumns({"start": F.col("start").cast("int"), "stop": F.col("stop").cast("int")})


def read_oneline(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _fields(_lines(spark, path), ["id", "bases"], comment=None)


def read_scarf(spark: SparkSession, path: str | list[str], offset: int = 64) -> DataFrame:
    """Colon-delimited reads: the name's fields, then bases and qualities."""
    head = F.regexp_extract("value", r"^(.*):([^:]*):([^:]*)$", 1)
    return _lines(spark, path).filter(F.length("value") > 0).select(head.alias("id"), F.regexp_extract("value", r"^(.*):([A-Za-z.]*):(.*)$", 2).alias("bases"), S.phred(F.regexp_extract("value", r"^(.*):([A-Za-z.]*):(.*)$", 3), offset).alias("quals"))


def read_gfa(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Segments: ``(id, bases)``."""
    parts = F.split("value", "\t", -1)
    return _lines(spark, path).filter(F.col("value").startswith("S\t")).select(parts[1].alias("id"), parts[2].alias("bases"))


def read_genbank(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """GenBank or EMBL records: ``(id, bases, features array<struct<type,location>>)``."""
    v = F.col("value")
    rows = _lines(spark, path, "\n//").filter(v.rlike(r"(?m)^\s*(LOCUS|ID)\s"))
    body = F.regexp_extract(v, r"(?s)\n(?:ORIGIN|SQ )[^\n]*\n(.*)$", 1)
    features = F.regexp_extract_all(v, F.lit(r"(?m)^(?:FT|  ) {3}([A-Za-z_']+ +[^\s]+)"), F.lit(1))
    return rows.select(F.regexp_extract(v, r"(?m)^\s*(?:LOCUS|ID)\s+([^\s;]+)", 1).alias("id"), F.upper(F.regexp_replace(body, r"[^A-Za-z]", "")).alias("bases"), F.transform(features, lambda f: F.struct(F.regexp_extract(f, r"^(\S+)", 1).alias("type"), F.regexp_extract(f, r"(\S+)$", 1).alias("location"))).alias("features"))


def read_phylip(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Interleaved alignments, a file a row of text: ``(id, bases)``."""
    texts = spark.read.text(path, wholetext=True)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                lines = [x for x in text.splitlines() if x.strip()]
                n = int(lines[0].split()[0])
                names = [x.split()[0] for x in lines[1 : n + 1]]
                parts = ["".join(x.split()[1:]) for x in lines[1 : n + 1]]
                for i, x in enumerate(lines[n + 1 :]):
                    parts[i % n] += "".join(x.split())
                yield pa.RecordBatch.from_pydict({"id": names, "bases": parts})

    return texts.mapInArrow(parse, "id string, bases string")


def read_coverage(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A table whose header line, with or without ``#``, names its columns."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    return rows.toDF(*[c.lstrip("#") for c in rows.columns])


def read_histogram(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _fields(_lines(spark, path), ["x", "count"]).select(F.col("x").cast("long"), F.col("count").cast("long"))


def read_matrix(spark: SparkSession, path: str | list[str], inputs: int) -> DataFrame:
    """``(features array<double>, label array<double>)`` of a training table; the ``#dims`` line is a comment."""
    numbers = F.transform(F.split("value", "\t"), lambda x: x.cast("double"))
    return _lines(spark, path).filter((F.length("value") > 0) & ~F.col("value").startswith("#")).select(F.slice(numbers, 1, inputs).alias("features"), F.slice(numbers, inputs + 1, 1 << 20).alias("label"))


def read_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(name)``, distinct; a FASTA header's mark is left out."""
    return _lines(spark, path).filter(F.length("value") > 0).select(F.regexp_replace("value", "^[>@]", "").alias("name")).distinct()


def read_taxonomy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """NCBI-style nodes: ``(tax_id, parent_id, rank)`` from ``|``-separated fields."""
    parts = F.transform(F.split("value", r"\|"), lambda x: F.trim(F.regexp_replace(x, "\t", " ")))
    return _lines(spark, path).filter(F.length("value") > 0).select(parts[0].cast("int").alias("tax_id"), parts[1].cast("int").alias("parent_id"), parts[2].alias("rank"))


def read_json(spark: SparkSession, path: str | list[str], schema: str | None = None, lines: bool = True) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", not lines).json(path)


def padded_spans(variants: DataFrame, pad: int) -> DataFrame:
    """Variants as half-open spans with ``pad`` on both sides."""
    start: Column = F.greatest(F.lit(0), F.col("pos") - 1 - pad)
    return variants.select("scaf", start.alias("start"), (F.col("pos") - 1 + F.length("ref") + pad).alias("stop"))


def read_accessions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Accession tables: ``(accession, version, tax_id, gi)`` from four tab-separated fields below a header line."""
    rows = _fields(_lines(spark, path).filter(~F.col("value").startswith("accession\t")), ["accession", "version", "tax_id", "gi"])
    return rows.withColumns({"tax_id": F.col("tax_id").try_cast("int"), "gi": F.col("gi").try_cast("long")})


def read_gi_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(gi, tax_id)``."""
    return _fields(_lines(spark, path), ["gi", "tax_id"]).select(F.col("gi").try_cast("long").alias("gi"), F.col("tax_id").try_cast("int").alias("tax_id")).filter("gi is not null")


def read_assembly_summary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Assembly summaries: a column a field of the last comment line above the rows."""
    lines = _lines(spark, path)
    header = lines.filter(F.col("value").rlike("^#+ *assembly_accession")).limit(1).first()
    names = header[0].lstrip("# ").split("\t") if header else ["assembly_accession"]
    return _fields(lines, names)


def read_names_table(spark: SparkSession, path: str | list[str], kind: str = "scientific name") -> DataFrame:
    """``(tax_id, name)`` of one kind of name from a table of ``|``-separated fields."""
    parts = F.transform(F.split("value", r"\|"), lambda x: F.trim(F.regexp_replace(x, "\t", " ")))
    return _lines(spark, path).filter(F.length("value") > 0).filter(parts[3] == kind).select(parts[0].cast("int").alias("tax_id"), parts[1].alias("name"))


def read_hmm_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tables of profile searches: ``(target, query, evalue, score, description)`` of whitespace-separated rows."""
    parts = F.split(F.trim("value"), r"\s+", 19)
    rows = _lines(spark, path).filter((F.length("value") > 0) & ~F.col("value").startswith("#"))
    return rows.select(parts[0].alias("target"), parts[2].alias("query"), parts[4].try_cast("double").alias("evalue"), parts[5].try_cast("double").alias("score"), F.get(parts, F.lit(18)).alias("description"))


def hmm_summary(report: DataFrame, most: float = 1e-5) -> DataFrame:
    """``(query, targets, best, score)``: how many targets each profile meets, and its best one."""
    good = report.filter(F.col("evalue") <= most)
    return good.groupBy("query").agg(F.countDistinct("target").alias("targets"), F.min(F.struct("evalue", (-F.col("score")).alias("s"), "target")).alias("m")).select("query", "targets", F.col("m.target").alias("best"), (-F.col("m.s")).alias("score"))


def read_gfa_links(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Links: ``(source, source_strand, target, target_strand, overlap)``."""
    parts = F.split("value", "\t", -1)
    return _lines(spark, path).filter(F.col("value").startswith("L\t")).select(*[parts[i + 1].alias(n) for i, n in enumerate(("source", "source_strand", "target", "target_strand", "overlap"))])


def twin_path(path: str) -> tuple[str, str]:
    """The two files a ``#`` in a path stands for."""
    return path.replace("#", "1"), path.replace("#", "2")


def quality_offset(reads: DataFrame, quals: str = "quals") -> int:
    """33 or 64, from the least quality of reads read with offset 33: none of offset 64 is below 26."""
    least = reads.agg(F.min(F.array_min(quals))).first()[0]
    return 64 if least is not None and least >= 26 else 33
