"""All queries of the engine and their SQL, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import alignment as A
from helixframe.functions import kmer as K
from helixframe.functions import sequence as S
from helixframe.operators import alignments as stats
from helixframe.operators import features, intervals, kmers, local_alignment
from helixframe.operators.derive import ALIGNMENTS, INTERVALS, READS, table
from helixframe.operators.derive import alignments as aligned
from helixframe.operators.derive import intervals as spans
from helixframe.operators.derive import reads
from helixframe.plans import files, sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_MEAN = "(CASE WHEN length(qual) = 0 THEN 0.0 ELSE (list_sum(list_transform(string_split(qual, ''), lambda c: unicode(c) - 33)))::DOUBLE / length(qual) END)"
_KMERS = "kmers AS (SELECT id, lang, substr(seq, i, {k}) AS kmer, i - 1 AS position FROM (SELECT id, lang, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM reads))"
_REF_LEN = "coalesce(list_sum(list_transform(list_filter(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda x: x[-1] IN ('M', 'D', 'N', '=', 'X')), lambda x: x[:-2]::BIGINT)), 0)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _of_reads(name: str, sql: str, columns: Callable[[Column, Column], dict[str, Column]]) -> None:
    """A projection of the reads' sequences and qualities; ``sql`` is its select list."""
    query(name, f"WITH {READS} SELECT id, {sql} FROM reads")(lambda spark, sf: reads(spark, sf).select("id", *[c.alias(n) for n, c in columns(F.col("seq"), F.col("qual")).items()]))


_count = lambda b: f"(length(seq) - length(replace(seq, '{b}', '')))"
_RC = f"reverse(translate(seq, '{S.COMPLEMENT_FROM}', '{S.COMPLEMENT_TO}'))"
_END = "regexp_replace(qual, '[!-4]+$', '')"
_START = "regexp_replace(qual, '^[!-4]+', '')"
_of_reads("base_counts", ", ".join(f"{_count(b)} AS {b.lower()}" for b in "ACGT"), lambda seq, qual: dict(**{b.lower(): S.count_char(seq, b) for b in "ACGT"}))
_of_reads("gc_content", f"CASE WHEN {_count('A')} + {_count('C')} + {_count('G')} + {_count('T')} = 0 THEN 0.0 ELSE ({_count('G')} + {_count('C')})::DOUBLE / ({_count('A')} + {_count('C')} + {_count('G')} + {_count('T')}) END AS gc", lambda seq, qual: dict(gc=S.gc_content(seq)))
_of_reads("complexity", "CASE WHEN length(seq) = 0 THEN 0.0 ELSE round((" + " + ".join(f"CASE WHEN {_count(b)} > 0 THEN -({_count(b)}::DOUBLE / length(seq)) * log2({_count(b)}::DOUBLE / length(seq)) ELSE 0.0 END" for b in "ACGT") + ") / 2, 9) END AS complexity", lambda seq, qual: dict(complexity=F.round(S.complexity(seq), 9)))
_of_reads("mean_quality", f"{_MEAN} AS mean_quality", lambda seq, qual: dict(mean_quality=S.mean_quality(qual)))
_of_reads("reverse_complement", f"{_RC} AS rc, reverse(qual) AS qual", lambda seq, qual: dict(rc=S.reverse_complement(seq), qual=F.reverse(qual)))
_of_reads("complement", f"translate(seq, '{S.COMPLEMENT_FROM}', '{S.COMPLEMENT_TO}') AS complement, reverse(seq) AS reversed", lambda seq, qual: dict(complement=S.complement(seq), reversed=F.reverse(seq)))
_of_reads("validity", f"regexp_full_match(seq, '[{S.DNA}]*') AS dna, regexp_full_match(seq, '[{S.RNA}]*') AS rna, length(regexp_replace(seq, '[{S.DNA}]', '', 'g')) AS invalid", lambda seq, qual: dict(dna=S.is_valid_dna(seq), rna=S.is_valid_rna(seq), invalid=S.count_invalid(seq)))
_of_reads("trim_fixed", "substr(seq, 6) AS no_start, substr(seq, 1, greatest(length(seq) - 7, 0)) AS no_end, substr(seq, 6, greatest(length(seq) - 12, 0)) AS middle", lambda seq, qual: dict(no_start=S.trim(seq, 5), no_end=S.trim(seq, 0, 7), middle=S.trim(seq, 5, 7)))
_of_reads("trim_quality_end", f"substr(seq, 1, length({_END})) AS seq, {_END} AS qual", lambda seq, qual: dict(seq=S.trim_quality(seq, qual, 20, start=False), qual=S.trim_quality(qual, qual, 20, start=False)))
_of_reads("trim_quality_start", f"substr(seq, length(qual) - length({_START}) + 1) AS seq, {_START} AS qual", lambda seq, qual: dict(seq=S.trim_quality(seq, qual, 20, end=False), qual=S.trim_quality(qual, qual, 20, end=False)))
_of_reads("trim_quality_both", f"substr(seq, length(qual) - length({_START}) + 1, length(regexp_replace({_START}, '[!-4]+$', ''))) AS seq, regexp_replace({_START}, '[!-4]+$', '') AS qual", lambda seq, qual: dict(seq=S.trim_quality(seq, qual, 20), qual=S.trim_quality(qual, qual, 20)))
_of_reads("trim_quality_window", "CASE WHEN length(qual) = 0 THEN 0 WHEN length(qual) < 5 THEN CASE WHEN list_sum(list_transform(string_split(qual, ''), lambda c: unicode(c) - 33)) // length(qual) >= 20 THEN length(qual) ELSE 0 END ELSE coalesce(list_max(list_filter(range(5, length(qual) + 1), lambda i: (unicode(qual[i]) + unicode(qual[i - 1]) + unicode(qual[i - 2]) + unicode(qual[i - 3]) + unicode(qual[i - 4]) - 165) // 5 >= 20)), length(qual)) END::INTEGER AS keep", lambda seq, qual: dict(keep=S.window_cut(qual, 20, 5)))
_of_reads("mask_low_quality", "coalesce(array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN unicode(qual[i]) < 53 THEN 'N' ELSE seq[i] END), ''), '') AS masked", lambda seq, qual: dict(masked=S.mask_low_quality(seq, qual, 20)))
_of_reads("count_masked", "length(seq) - length(translate(seq, 'Nn', '')) AS masked", lambda seq, qual: dict(masked=S.count_masked(seq)))


@query("extract_region", f"WITH {READS} SELECT id, substr(seq, 3, 10) AS seq, substr(qual, 3, 10) AS qual FROM reads WHERE length(seq) >= 12")
def _(spark, sf):
    return reads(spark, sf).where(F.length("seq") >= 12).select("id", S.region(F.col("seq"), 2, 12).alias("seq"), S.region(F.col("qual"), 2, 12).alias("qual"))


@query("quality_filter", f"WITH {READS} SELECT id, length(seq)::BIGINT AS n FROM reads WHERE {_MEAN} >= 20 AND length(seq) BETWEEN 30 AND 100000")
def _(spark, sf):
    return reads(spark, sf).where(S.passes_quality(F.col("qual"), 20) & S.meets_length(F.col("seq"), 30, 100000)).select("id", F.length("seq").cast("bigint").alias("n"))


@query("fasta_lines", f"WITH {READS} SELECT id, '>' || id || chr(10) || regexp_replace(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS record FROM reads WHERE length(seq) > 0")
def _(spark, sf):
    from helixframe.sources.writers import fasta_lines

    return reads(spark, sf).where(F.length("seq") > 0).select("id", fasta_lines(F.col("id").cast("string"), F.col("seq")).alias("record"))


@query("flagship_qc", f"""WITH {READS}, t AS (SELECT lang, substr(seq, 1, length({_END})) AS seq, {_END} AS qual FROM reads)
  SELECT lang, count(*) AS n, sum(length(seq))::BIGINT AS bases, round(avg(CASE WHEN {_count('A')} + {_count('C')} + {_count('G')} + {_count('T')} = 0 THEN 0.0 ELSE ({_count('G')} + {_count('C')})::DOUBLE / ({_count('A')} + {_count('C')} + {_count('G')} + {_count('T')}) END), 9) AS gc
  FROM t WHERE {_MEAN} >= 20 AND length(seq) >= 30 GROUP BY lang""")
def flagship_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trim ends below Q20, keep reads of mean Q20 and 30 bases, and describe them by language."""
    end = reads(spark, sf_dir).select("lang", F.inline(F.array(F.struct("seq", "qual", S.quality_end(F.col("qual"), 20).alias("n")))))
    cut = end.select("lang", F.substr("seq", F.lit(1), "n").alias("seq"), F.substr("qual", F.lit(1), "n").alias("qual"))
    kept = cut.where((F.length("seq") >= 30) & S.passes_quality(F.col("qual"), 20))
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"), F.round(F.avg(S.gc_content(F.col("seq"))), 9).alias("gc"))


_K6 = _KMERS.format(k=6) + ", valid AS (SELECT * FROM kmers WHERE regexp_full_match(kmer, '[ACGT]+'))"


@query("kmer_spectrum", f"WITH {READS}, {_K6} SELECT kmer, count(*) AS n FROM valid GROUP BY kmer")
def _(spark, sf):
    return kmers.spectrum(reads(spark, sf), 6)


@query("kmer_distinct", f"WITH {READS}, {_K6} SELECT lang, count(DISTINCT kmer) AS n FROM valid GROUP BY lang")
def _(spark, sf):
    return kmers.spectrum(reads(spark, sf), 6, ["lang"]).groupBy("lang").agg(F.count("*").alias("n"))


@query("kmer_shared", f"WITH {READS}, {_K6} SELECT DISTINCT kmer FROM valid WHERE lang = 'en' INTERSECT SELECT kmer FROM valid WHERE lang = 'de'")
def _(spark, sf):
    found = kmers.spectrum(reads(spark, sf), 6, ["lang"])
    return found.where("lang = 'en'").select("kmer").intersect(found.where("lang = 'de'").select("kmer"))


@query("kmer_difference", f"WITH {READS}, {_K6} SELECT DISTINCT kmer FROM valid WHERE lang = 'en' EXCEPT SELECT kmer FROM valid WHERE lang = 'fr'")
def _(spark, sf):
    found = kmers.spectrum(reads(spark, sf), 6, ["lang"])
    return found.where("lang = 'en'").select("kmer").exceptAll(found.where("lang = 'fr'").select("kmer"))


@query("minimizers_fnv", f"""WITH {READS}, {_KMERS.format(k=5)}, v AS (SELECT * FROM kmers WHERE regexp_full_match(kmer, '[ACGT]+')), d AS (SELECT DISTINCT kmer FROM v),
  h AS (SELECT kmer, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(kmer, ''), lambda c: unicode(c)::UHUGEINT)), lambda a, c: (xor(a, c) * 1099511628211) % 18446744073709551616) AS hash FROM d),
  p AS (SELECT id, position, hash FROM v JOIN h USING (kmer)), n AS (SELECT id, greatest(length(seq) - 5 + 1 - 4, 0) AS last FROM reads WHERE length(seq) >= 5),
  w AS (SELECT id, unnest(range(greatest(position - 3, 0), least(position, last) + 1)) AS start, hash, position FROM p JOIN n USING (id)),
  m AS (SELECT id, start, min(struct_pack(hash := hash, position := position)) AS m FROM w GROUP BY id, start)
  SELECT DISTINCT id, m.position::BIGINT AS position, (m.hash // 4294967296)::BIGINT AS hi, (m.hash % 4294967296)::BIGINT AS lo FROM m""")
def _(spark, sf):
    return kmers.minimizers(reads(spark, sf), 5, 4)


@query("minimizer_kmers", f"SELECT m.id, m.position, substr(seq, m.position + 1, 5) AS kmer FROM ({_SQL['minimizers_fnv']}) m JOIN (WITH {READS} SELECT id, seq FROM reads) r ON r.id = m.id")
def _(spark, sf):
    return kmers.minimizer_kmers(reads(spark, sf), 5, 4)


def _nthash_sql(k: int) -> str:
    """The canonical ntHash of ``kmer`` as an unsigned number: rotated seeds are constants; other letters than bases hash as 0."""
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & ((1 << 64) - 1)
    pair = {"A": "T", "C": "G", "G": "C", "T": "A"}

    def strand(seed: Callable[[str], int], by: Callable[[int], int]) -> str:
        out = "0::UHUGEINT"
        for i in range(k):
            out = f"xor({out}, CASE kmer[{i + 1}] " + " ".join(f"WHEN '{b}' THEN {turn(seed(b), by(i))}::UHUGEINT" for b in "ACGT") + " ELSE 0::UHUGEINT END)"
        return out

    return f"least({strand(lambda b: K.NT_SEEDS[b], lambda i: k - 1 - i)}, {strand(lambda b: K.NT_SEEDS[pair[b]], lambda i: i)})"


@query("minimizers_nthash", f"""WITH {READS}, {_KMERS.format(k=5)}, h AS (SELECT kmer, {_nthash_sql(5)} AS hash FROM (SELECT DISTINCT kmer FROM kmers)),
  p AS (SELECT id, position, hash FROM kmers JOIN h USING (kmer)), n AS (SELECT id, length(seq) - 8 AS last FROM reads WHERE length(seq) >= 8),
  w AS (SELECT id, unnest(range(greatest(position - 3, 0), least(position, last) + 1)) AS start, hash, position FROM p JOIN n USING (id)),
  m AS (SELECT id, start, min(struct_pack(hash := hash, position := position)) AS m FROM w GROUP BY id, start)
  SELECT DISTINCT id, m.position::BIGINT AS position, (CASE WHEN m.hash >= 9223372036854775808 THEN m.hash::HUGEINT - 18446744073709551616 ELSE m.hash::HUGEINT END)::BIGINT AS hash FROM m""")
def _(spark, sf):
    return kmers.nthash_minimizers(reads(spark, sf), 5, 4)


@query("sliding_min", """SELECT user_id, event_id, v AS value, min_at FROM (SELECT user_id, event_id, (min(struct_pack(v := value, "at" := event_id)) OVER w).v AS v, (min(struct_pack(v := value, "at" := event_id)) OVER w)."at" AS min_at,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n >= 4""")
def _(spark, sf):
    return kmers.sliding_min(table(spark, sf, "events"), 4, "user_id", "event_id", "value")


@query("smith_waterman")
def _(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return names.select("p_partkey", local_alignment.smith_waterman(F.col("p_name"), F.col("p_type")).alias("a")).select("p_partkey", "a.*")


_JOIN = 'FROM intervals a JOIN intervals b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"'


@query("interval_overlaps", f"WITH {INTERVALS} SELECT a.id AS l_id, b.id AS r_id {_JOIN} AND a.id < b.id")
def _(spark, sf):
    return intervals.self_overlaps(spans(spark, sf))


@query("interval_contains", f'WITH {INTERVALS} SELECT a.id AS l_id, b.id AS r_id {_JOIN} AND a.start <= b.start AND a."end" >= b."end" AND a.id <> b.id')
def _(spark, sf):
    return intervals.self_overlaps(spans(spark, sf), contained=True)


_MERGED = """marked AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS fresh FROM intervals {where}),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked),
  merged AS (SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM islands GROUP BY chrom, island)"""


@query("interval_merge", f"WITH {INTERVALS}, {_MERGED.format(where='')} SELECT * FROM merged")
def _(spark, sf):
    return intervals.merge(spans(spark, sf))


@query("interval_subtract", f"""WITH {INTERVALS}, a AS (SELECT * FROM intervals WHERE chrom < 2), b AS (SELECT id, chrom - 2 AS chrom, start, "end" FROM intervals WHERE chrom >= 2),
  pos AS (SELECT id, chrom, unnest(range(start, "end")) AS p FROM a), cov AS (SELECT DISTINCT chrom, unnest(range(start, "end")) AS p FROM b),
  free AS (SELECT * FROM pos ANTI JOIN cov USING (chrom, p)), g AS (SELECT *, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM free)
  SELECT id, chrom, min(p) AS start, max(p) + 1 AS "end" FROM g GROUP BY id, chrom, g""")
def _(spark, sf):
    df = spans(spark, sf)
    return intervals.subtract(df.where("chrom < 2"), df.where("chrom >= 2").withColumn("chrom", F.col("chrom") - 2))


@query("nearest_before", f"WITH {INTERVALS}, a AS (SELECT * FROM intervals WHERE chrom < 2), b AS (SELECT DISTINCT chrom - 2 AS chrom, start FROM intervals WHERE chrom >= 2) SELECT a.id, a.chrom, a.start, b.start AS near FROM a ASOF LEFT JOIN b ON a.chrom = b.chrom AND a.start >= b.start")
def _(spark, sf):
    df = spans(spark, sf)
    return intervals.nearest_before(df.where("chrom < 2"), df.where("chrom >= 2").withColumn("chrom", F.col("chrom") - 2))


_DEPTH = f'WITH {INTERVALS}, d AS (SELECT chrom, p AS position, count(*) AS depth FROM (SELECT chrom, unnest(range(start, "end")) AS p FROM intervals) GROUP BY chrom, p)'


@query("coverage", f"{_DEPTH} SELECT * FROM d")
def _(spark, sf):
    return intervals.depth(spans(spark, sf))


@query("coverage_stats", f"{_DEPTH} SELECT chrom, count(*) AS positions, min(depth) AS least, max(depth) AS greatest, round(avg(depth), 9) AS mean, count(*) FILTER (depth < 2) AS low FROM d GROUP BY chrom")
def _(spark, sf):
    return intervals.depth(spans(spark, sf)).groupBy("chrom").agg(F.count("*").alias("positions"), F.min("depth").alias("least"), F.max("depth").alias("greatest"), F.round(F.avg("depth"), 9).alias("mean"), F.count_if(F.col("depth") < 2).alias("low"))


@query("coverage_top", f"{_DEPTH} SELECT * FROM d ORDER BY depth DESC, chrom, position LIMIT 5")
def _(spark, sf):
    return intervals.depth(spans(spark, sf)).orderBy(F.desc("depth"), "chrom", "position").limit(5)


_BIT = lambda b: f"flags & {b} <> 0"


@query("flag_counts", f"WITH {ALIGNMENTS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in {"mapped": "flags & 4 = 0", "unmapped": _BIT(4), "primary_reads": "flags & 2304 = 0", "secondary": _BIT(256), "supplementary": _BIT(2048), "paired": _BIT(1), "proper_pair": _BIT(2), "forward": "flags & 16 = 0", "reverse": _BIT(16), "qc_fail": _BIT(512), "duplicate": _BIT(1024)}.items()) + " FROM alignments")
def _(spark, sf):
    return stats.flag_counts(aligned(spark, sf))


@query("flag_counts_long", f"WITH {ALIGNMENTS}, c AS (SELECT count(*) FILTER (flags & 4 = 0) AS mapped, count(*) FILTER (flags & 16 <> 0) AS reverse FROM alignments) UNPIVOT c ON mapped, reverse INTO NAME counter VALUE n")
def _(spark, sf):
    return stats.flag_counts(aligned(spark, sf)).unpivot([], ["mapped", "reverse"], "counter", "n")


@query("mapq_histogram", f"WITH {ALIGNMENTS} SELECT coalesce(mapq, 255) AS mapq, count(*) AS n FROM alignments GROUP BY 1")
def _(spark, sf):
    return stats.mapq_distribution(aligned(spark, sf))


_INSERTS = f"WITH {ALIGNMENTS} SELECT abs(template_length) AS insert_size, count(*) AS n FROM alignments WHERE flags & 3 = 3 AND flags & 2304 = 0 AND reference_id IS NOT DISTINCT FROM mate_reference_id AND template_length <> 0 GROUP BY 1"


@query("insert_sizes", _INSERTS)
def _(spark, sf):
    return stats.insert_sizes(aligned(spark, sf))


@query("insert_sizes_top", f"{_INSERTS} ORDER BY n DESC, insert_size LIMIT 10")
def _(spark, sf):
    return stats.insert_sizes(aligned(spark, sf)).orderBy(F.desc("n"), "insert_size").limit(10)


@query("edit_distance_stats", f"WITH {ALIGNMENTS} SELECT count(*) AS total, count(nm) AS with_nm, avg(nm) AS mean, list_sort(list(nm) FILTER (nm IS NOT NULL))[count(nm) // 2 + 1] AS median, min(nm) AS least, max(nm) AS greatest FROM alignments")
def _(spark, sf):
    return stats.edit_distance_stats(aligned(spark, sf))


@query("strand_bias", f"WITH {ALIGNMENTS}, r AS (SELECT * FROM alignments WHERE reference_id = 1 AND position < 5051 AND position + {_REF_LEN} > 4950) SELECT count(*) FILTER (flags & 16 = 0) AS forward, count(*) FILTER (flags & 16 <> 0) AS reverse, count(*) AS total, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (flags & 16 = 0) / count(*)::DOUBLE END AS ratio FROM r")
def _(spark, sf):
    return stats.strand_bias(aligned(spark, sf), 1, 5000, 100)


@query("region_overlap", f"WITH {ALIGNMENTS} SELECT l_orderkey, l_linenumber, position FROM alignments WHERE reference_id = 2 AND position < 6000 AND position + {_REF_LEN} > 3000")
def _(spark, sf):
    return stats.region_query(aligned(spark, sf), 2, 3000, 6000).select("l_orderkey", "l_linenumber", "position")


@query("region_starts", f"WITH {ALIGNMENTS} SELECT l_orderkey, l_linenumber, position FROM alignments WHERE reference_id = 2 AND position >= 3000 AND position < 6000")
def _(spark, sf):
    return stats.region_starts(aligned(spark, sf), 2, 3000, 6000).select("l_orderkey", "l_linenumber", "position")


@query("alignment_lengths", f"WITH {ALIGNMENTS} SELECT {_REF_LEN}::INTEGER AS reference_length, count(*) AS n FROM alignments WHERE flags & 4 = 0 GROUP BY 1")
def _(spark, sf):
    return stats.alignment_lengths(aligned(spark, sf))


@query("coverage_of_starts", f"WITH {ALIGNMENTS}, p AS (SELECT unnest(range(position, least(position + {_REF_LEN}::BIGINT, 40000))) AS position FROM alignments WHERE reference_id = 2 AND position >= 2000 AND position < 40000) SELECT position, count(*) AS depth FROM p GROUP BY 1")
def _(spark, sf):
    return stats.coverage_of_starts(aligned(spark, sf), 2, 2000, 40000)


@query("high_mapq", f"WITH {ALIGNMENTS} SELECT l_orderkey, l_linenumber, mapq FROM alignments WHERE mapq >= 30 AND mapq < 255")
def _(spark, sf):
    return aligned(spark, sf).where(A.is_high_quality(F.col("mapq"), 30)).select("l_orderkey", "l_linenumber", "mapq")


@query("quality_features", f"""WITH {READS} SELECT id, 2 * length(seq) AS n, list_sum(list_transform(string_split(seq, ''), lambda c: CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END))::BIGINT AS bases, list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c)))::BIGINT AS scores FROM reads WHERE length(seq) > 0""")
def _(spark, sf):
    """The features of each read's quality model, as sums of both halves in their steps."""
    df = reads(spark, sf).where("seq <> ''").select("id", S.quality_features(F.col("seq"), F.col("qual")).alias("f"))
    total = lambda a, steps: F.aggregate(a, F.lit(0).cast("bigint"), lambda t, x: t + F.round(x * steps).cast("bigint"))
    half = F.expr("size(f) DIV 2").cast("int")
    return df.select("id", F.size("f").cast("bigint").alias("n"), total(F.slice("f", F.lit(1), half), 4).alias("bases"), total(F.slice("f", half + 1, half), 93).alias("scores"))


@query("read_mismatches", f"""WITH {READS}, r AS (SELECT id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS other FROM reads), m AS (SELECT id, seq, list_filter(range(length(seq)), lambda i: substr(seq, i + 1, 1) <> substr(other, i + 1, 1)) AS places FROM r)
  SELECT id, len(places)::BIGINT AS n, places[1]::BIGINT AS first, places[-1]::BIGINT AS last, seq AS restored FROM m""")
def _(spark, sf):
    """Each read against its reverse complement, which the differences turn into the read again."""
    df = reads(spark, sf).select("id", "seq", S.reverse_complement(F.col("seq")).alias("other"))
    df = df.select("id", "other", A.differences(F.col("seq"), F.col("other")).alias("m"))
    at = lambda i: F.try_element_at("m.positions", F.lit(i)).cast("bigint")
    restored = A.substituted(F.col("other"), F.col("m.positions"), F.col("m.bases"))
    return df.select("id", F.size("m.positions").cast("bigint").alias("n"), at(1).alias("first"), at(-1).alias("last"), restored.alias("restored"))


@query("cigar_totals", f"WITH {ALIGNMENTS}, o AS (SELECT unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS x FROM alignments) SELECT x[-1] AS op, sum(x[:-2]::BIGINT)::BIGINT AS bases, count(*) AS n FROM o GROUP BY 1")
def _(spark, sf):
    return stats.cigar_totals(aligned(spark, sf))


@query("cigar_text", f"WITH {ALIGNMENTS} SELECT l_orderkey, l_linenumber, cigar, {_REF_LEN}::INTEGER AS on_reference FROM alignments")
def _(spark, sf):
    ops = A.parse_cigar(F.col("cigar"))
    return aligned(spark, sf).select("l_orderkey", "l_linenumber", A.format_cigar(A.compress_cigar(ops)).alias("cigar"), A.cigar_length(ops).alias("on_reference"))


@query("sites_depth", f"""WITH {ALIGNMENTS}, s AS (SELECT DISTINCT p_partkey % 4 AS reference_id, p_partkey * 50 + 30 AS position FROM part),
  o AS (SELECT reference_id, position, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS ops FROM alignments), u AS (SELECT *, unnest(range(1, len(ops) + 1)) AS i FROM o),
  b AS (SELECT reference_id, position + coalesce(list_sum(list_transform(list_filter(ops[:i - 1], lambda x: x[-1] IN ('M', 'D', 'N', '=', 'X')), lambda x: x[:-2]::BIGINT)), 0) AS start, ops[i][:-2]::BIGINT AS n FROM u WHERE ops[i][-1] IN ('M', '=', 'X'))
  SELECT s.reference_id, s.position, count(*) AS depth FROM s JOIN b ON s.reference_id = b.reference_id AND s.position >= b.start AND s.position < b.start + b.n GROUP BY 1, 2""")
def _(spark, sf):
    sites = table(spark, sf, "part").select((F.col("p_partkey") % 4).alias("reference_id"), (F.col("p_partkey") * 50 + 30).alias("position")).distinct()
    return stats.bases_at(aligned(spark, sf), sites)


@query("reads_by_strand", f"WITH {ALIGNMENTS} SELECT reference_id, flags & 16 <> 0 AS reverse, count(*) AS n FROM alignments GROUP BY ROLLUP (reference_id, flags & 16 <> 0)")
def _(spark, sf):
    df = aligned(spark, sf).select("reference_id", A.has(F.col("flags"), "reverse").alias("reverse"))
    return df.rollup("reference_id", "reverse").agg(F.count("*").alias("n"))


@query("cube_sources", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (lang, source)")
def _(spark, sf):
    return table(spark, sf, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


_VARIANTS = "variants AS (SELECT p_partkey AS id, upper(substr(p_name, 1, 1 + p_size % 2)) AS ref, CASE WHEN p_size % 5 = 0 THEN ['A', 'CT'] WHEN p_size % 3 = 0 THEN ['GTA'] ELSE ['C'] END AS alt, CASE WHEN p_size % 7 = 0 THEN 'LowQual' ELSE 'PASS' END AS filter FROM part)"


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    alt = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("A"), F.lit("CT"))).when(F.col("p_size") % 3 == 0, F.array(F.lit("GTA"))).otherwise(F.array(F.lit("C")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.upper(F.substr("p_name", F.lit(1), 1 + F.col("p_size") % 2)).alias("ref"), alt.alias("alt"), F.when(F.col("p_size") % 7 == 0, "LowQual").otherwise("PASS").alias("filter"))


@query("variant_classes", f"WITH {_VARIANTS} SELECT id, length(ref) = 1 AND len(list_filter(alt, lambda a: length(a) <> 1)) = 0 AS snp, len(list_filter(alt, lambda a: length(a) > length(ref))) > 0 AS insertion, len(list_filter(alt, lambda a: length(a) < length(ref))) > 0 AS deletion FROM variants")
def _(spark, sf):
    r, a = F.col("ref"), F.col("alt")
    return _variants(spark, sf).select("id", A.is_snp(r, a).alias("snp"), A.is_insertion(r, a).alias("insertion"), A.is_deletion(r, a).alias("deletion"))


@query("variant_filters", f"WITH {_VARIANTS} SELECT count(*) FILTER (filter = 'PASS') AS passed, count(*) FILTER (filter <> 'PASS') AS filtered FROM variants")
def _(spark, sf):
    return _variants(spark, sf).agg(F.count_if(F.col("filter") == "PASS").alias("passed"), F.count_if(F.col("filter") != "PASS").alias("filtered"))


@query("feature_hierarchy", "SELECT n_nationkey AS gene, n_name AS name, count(DISTINCT c_custkey) AS transcripts, count(o_orderkey) AS exons FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def _(spark, sf):
    genes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    transcripts = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"))
    exons = features.children(transcripts, table(spark, sf, "orders").select(F.col("o_custkey").alias("parent")), "exons")
    per_gene = exons.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("transcripts"), F.sum("exons").alias("exons"))
    joined = genes.join(per_gene, "id", "left")
    return joined.select(F.col("id").alias("gene"), F.col("n_name").alias("name"), F.coalesce("transcripts", F.lit(0)).alias("transcripts"), F.coalesce("exons", F.lit(0)).alias("exons"))


_UTRS = "u AS (SELECT o_custkey AS parent, CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderkey AS start, o_orderkey + o_custkey % 90 AS stop FROM orders)"


@query("utr_lengths", f"WITH {_UTRS} SELECT parent, sum(CASE WHEN (side = 'left') = (strand = '+') THEN stop - start + 1 ELSE 0 END)::BIGINT AS five_prime, sum(CASE WHEN (side = 'left') = (strand = '+') THEN 0 ELSE stop - start + 1 END)::BIGINT AS three_prime FROM u GROUP BY parent")
def _(spark, sf):
    o = table(spark, sf, "orders")
    utrs = o.select(F.col("o_custkey").alias("parent"), F.when(F.col("o_orderkey") % 2 == 0, "left").otherwise("right").alias("side"), F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 90).alias("end"))
    return features.utr_lengths(utrs)


@query("biotype_counts", "SELECT p_type AS biotype, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("biotype")).agg(F.count("*").alias("n"))


_GRAPH = "s AS (SELECT p_partkey AS name, p_size AS length FROM part), e AS (SELECT l_partkey AS a, l_partkey + l_suppkey AS b FROM lineitem)"


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    segments = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").cast("bigint").alias("length"))
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("from_segment"), (F.col("l_partkey") + F.col("l_suppkey")).alias("to_segment"))
    return segments, edges


@query("graph_degrees", f"WITH {_GRAPH}, i AS (SELECT b AS name, count(*) AS n FROM e GROUP BY b), o AS (SELECT a AS name, count(*) AS n FROM e GROUP BY a) SELECT s.name, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM s LEFT JOIN i USING (name) LEFT JOIN o USING (name)")
def _(spark, sf):
    return features.degrees(*_graph(spark, sf))


@query("graph_branches", f"WITH {_GRAPH} SELECT a AS name, count(*) AS out_degree FROM e JOIN s ON s.name = a GROUP BY a HAVING count(*) > 1")
def _(spark, sf):
    return features.degrees(*_graph(spark, sf)).where("out_degree > 1").select("name", "out_degree")


@query("graph_ends", f"WITH {_GRAPH} SELECT name, 'source' AS kind FROM s WHERE name NOT IN (SELECT b FROM e) UNION ALL SELECT name, 'sink' FROM s WHERE name NOT IN (SELECT a FROM e)")
def _(spark, sf):
    return features.ends(*_graph(spark, sf))


@query("graph_paths", "SELECT l_orderkey AS path, sum(p_size)::BIGINT AS bases, count(*) AS steps FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(spark, sf):
    segments, _ = _graph(spark, sf)
    named = segments.withColumn("name", F.col("name").cast("string"))
    steps = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.collect_list(F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"))).alias("steps"))
    return features.path_lengths(steps, named)


@query("match_identity", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 0 THEN 0.0 ELSE (l_quantity - l_linenumber) / l_quantity END AS identity, l_quantity >= 20 AND l_quantity < 255 AS good FROM lineitem")
def _(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", A.fraction(q - F.col("l_linenumber"), q).alias("identity"), A.is_high_quality(q, 20).alias("good"))


@query("best_match", "SELECT l_orderkey, l_linenumber, l_extendedprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def _(spark, sf):
    best = F.max_by(F.struct("l_linenumber", "l_extendedprice"), F.struct("l_extendedprice", -F.col("l_linenumber")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.l_linenumber", F.col("b.l_extendedprice").alias("score"))


@query("labelled_reads", "SELECT l.quality, count(*) AS n, count(DISTINCT d.lang) AS langs FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))


@query("unlabelled_reads", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("length_ranks", "SELECT doc_id, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS quarter FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC)")
def _(spark, sf):
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"))
    return table(spark, sf, "documents").select("doc_id", F.rank().over(w).cast("bigint").alias("rank"), F.dense_rank().over(w).cast("bigint").alias("dense"), F.ntile(4).over(w.orderBy(F.desc("n_chars"), "doc_id")).cast("bigint").alias("quarter"))


@query("interval_gaps", f'WITH {INTERVALS} SELECT id, start - lag("end") OVER (PARTITION BY chrom ORDER BY start, id) AS gap FROM intervals')
def _(spark, sf):
    return spans(spark, sf).select("id", (F.col("start") - F.lag("end").over(Window.partitionBy("chrom").orderBy("start", "id"))).alias("gap"))


@query("depth_smoothed", f"{_DEPTH} SELECT chrom, position, sum(depth) OVER (PARTITION BY chrom ORDER BY position RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING)::BIGINT AS near FROM d")
def _(spark, sf):
    w = Window.partitionBy("chrom").orderBy("position").rangeBetween(-50, 50)
    return intervals.depth(spans(spark, sf)).select("chrom", "position", F.sum("depth").over(w).alias("near"))


@query("delta_decode", "SELECT user_id, event_id, sum(d) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS value FROM (SELECT user_id, event_id, event_id - lag(event_id, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    deltas = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") - F.lag("event_id", 1, 0).over(w)).alias("d"))
    return deltas.select("user_id", "event_id", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


@query("pivot_status", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("tumbling_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("session_events", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("length_percentiles", "SELECT lang, quantile_cont(n_chars, 0.05) AS p05, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.95) AS p95 FROM documents GROUP BY lang")
def _(spark, sf):
    p = F.percentile("n_chars", [0.05, 0.5, 0.95])
    return table(spark, sf, "documents").groupBy("lang").agg(p.alias("p")).select("lang", F.col("p")[0].alias("p05"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p95"))


_N50 = "c AS (SELECT lang, length(seq) AS n, count(*) AS k FROM reads GROUP BY 1, 2), r AS (SELECT lang, n, sum(n * k) OVER (PARTITION BY lang ORDER BY n DESC) AS upto, sum(n * k) OVER (PARTITION BY lang) AS total FROM c)"


@query("n50", f"WITH {READS}, {_N50} SELECT lang, max(n)::BIGINT AS n50 FROM r WHERE upto * 2 >= total GROUP BY lang")
def _(spark, sf):
    return stats.n50(reads(spark, sf).select("lang", F.length("seq").cast("bigint").alias("n")), "lang", "n")


@query("sampled_reads", f"WITH {READS} SELECT id, length(seq)::BIGINT AS n FROM reads WHERE (id * 2654435761) % 4294967296 < 429496729")
def _(spark, sf):
    """A tenth by a hash of the id, the same at every run."""
    return reads(spark, sf).where((F.col("id") * 2654435761) % 4294967296 < 429496729).select("id", F.length("seq").cast("bigint").alias("n"))


@query("first_reads", "SELECT doc_id AS id, n_chars FROM documents ORDER BY doc_id LIMIT 10000")
def _(spark, sf):
    """The first 10,000 by id: the limit is the feature."""
    return table(spark, sf, "documents").orderBy("doc_id").limit(10000).select(F.col("doc_id").alias("id"), "n_chars")


@query("props_by_day", "SELECT ts::DATE AS day, event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query("all_names", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION ALL SELECT DISTINCT p_type FROM part")
def _(spark, sf):
    name = lambda t, c: table(spark, sf, t).select(F.col(c).alias("name"))
    return name("nation", "n_name").union(name("region", "r_name")).distinct().union(name("part", "p_type").distinct())


@query("reference_names", f"WITH {ALIGNMENTS}, names AS (SELECT r_regionkey AS id, r_name AS name FROM region) SELECT coalesce(name, '*') AS name, count(*) AS n FROM alignments LEFT JOIN names ON id = reference_id GROUP BY 1")
def _(spark, sf):
    """Alignments by the name of their reference: a header's list of names is small by its nature, and checked."""
    names = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return stats.by_reference_name(aligned(spark, sf), names)


@query("theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND length(a.n_name) > length(b.n_name)")
def _(spark, sf):
    """A join on inequalities, of a table that has a row for each nation."""
    n = table(spark, sf, "nation")
    a, b = n.alias("a"), F.broadcast(n).alias("b")
    return a.join(b, (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.length("a.n_name") > F.length("b.n_name"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("sliding_events", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * i) AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("graph_totals", f"WITH {_GRAPH} SELECT count(*) AS segments, sum(length)::BIGINT AS bases, min(length) AS shortest, max(length) AS longest, avg(length) AS mean, (SELECT count(*) FROM e) AS links FROM s")
def _(spark, sf):
    return features.totals(*_graph(spark, sf))


@query("read_group_counts", "SELECT 'rg' || (l_suppkey % 8) AS read_group, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.concat(F.lit("rg"), (F.col("l_suppkey") % 8).cast("string")).alias("read_group")).agg(F.count("*").alias("n"))


@query("kmer_jaccard", f"WITH {READS}, {_K6}, d AS (SELECT DISTINCT lang, kmer FROM valid), n AS (SELECT lang, count(*) AS n FROM d GROUP BY 1), b AS (SELECT a.lang AS a, b.lang AS b, count(*) AS shared FROM d a JOIN d b ON a.kmer = b.kmer AND a.lang < b.lang GROUP BY 1, 2) SELECT a, b, shared::DOUBLE / (x.n + y.n - shared) AS jaccard FROM b JOIN n x ON x.lang = a JOIN n y ON y.lang = b")
def _(spark, sf):
    return kmers.jaccard(kmers.spectrum(reads(spark, sf), 6, ["lang"]), "lang")


_SPANS = f"{ALIGNMENTS}, sp AS (SELECT reference_id, position, {_REF_LEN}::BIGINT AS n FROM alignments WHERE flags & 4 = 0), dp AS (SELECT reference_id, unnest(range(position, position + n)) AS p FROM sp)"


@query("alignment_coverage", f"WITH {_SPANS} SELECT reference_id, (p // 1000)::BIGINT AS bin, count(*) AS bases, count(DISTINCT p) AS covered FROM dp GROUP BY 1, 2")
def _(spark, sf):
    """Depth over the reference spans of every CIGAR, by 1,000 positions."""
    return stats.coverage_bins(aligned(spark, sf), 1000)


@query("qc_report", f"WITH {ALIGNMENTS} SELECT count(*) AS n, count(*) FILTER (flags & 4 = 0) AS mapped, count(*) FILTER (flags & 2 <> 0) AS proper, count(*) FILTER (flags & 1024 <> 0) AS duplicates, count(*) FILTER (flags & 256 <> 0) AS secondary, count(*) FILTER (mapq >= 30) AS high_mapq, avg(mapq) AS mean_mapq, sum(nm)::BIGINT AS edits, max(abs(template_length)) AS longest_insert, sum({_REF_LEN})::BIGINT AS reference_bases FROM alignments")
def _(spark, sf):
    return stats.qc_report(aligned(spark, sf))


@query("depth_shares", f"{_DEPTH} SELECT chrom, count(*) AS covered, count(*) FILTER (depth >= 3)::DOUBLE / count(*) AS share_3, count(*) FILTER (depth >= 10)::DOUBLE / count(*) AS share_10, quantile_cont(depth, 0.5) AS median FROM d GROUP BY chrom")
def _(spark, sf):
    return stats.depth_shares(intervals.depth(spans(spark, sf)), (3, 10))


@query("sql_functions", f"WITH {READS} SELECT lang, count(*) AS n, round(avg(CASE WHEN {_count('A')} + {_count('C')} + {_count('G')} + {_count('T')} = 0 THEN 0.0 ELSE ({_count('G')} + {_count('C')})::DOUBLE / ({_count('A')} + {_count('C')} + {_count('G')} + {_count('T')}) END), 9) AS gc, sum(length(regexp_replace(seq, '[{S.DNA}]', '', 'g')))::BIGINT AS invalid, count(*) FILTER (length(qual) >= 30) AS long FROM reads GROUP BY lang")
def _(spark, sf):
    """The SQL entry: views and functions of the engine, called by name."""
    sql.register(spark, {"reads": reads(spark, sf)})
    return spark.sql("SELECT lang, count(*) AS n, round(avg(hf_gc_content(seq)), 9) AS gc, sum(hf_count_invalid(seq)) AS invalid, count_if(hf_meets_length(qual, 30, 1000000000)) AS long FROM reads GROUP BY lang")


def queries() -> dict[str, Query]:
    return _QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | files.SQL
