"""Plans over reads, one SQL text each, run by Spark and checked by DuckDB.

Keys are the operator's number and a slug. Counts are BIGINT and doubles are
rounded, so that both engines give equal values.
"""

from __future__ import annotations

from .views import BINS, TOKEN_OP_SQL, TOKEN_VALUE_SQL, binned

B = "CAST({} AS BIGINT)".format
_BASE = "(SELECT read_id, i, substr(seq, i, 1) AS b FROM (SELECT read_id, seq, @EX(length(seq))@ AS i FROM reads))"
_QUALS = "(SELECT read_id, i, ascii(substr(qual, i, 1)) - 33 AS q FROM (SELECT read_id, qual, @EX(length(qual))@ AS i FROM reads))"
_COUNT = ", ".join(f"sum(length(seq) - length(replace(seq, '{b}', ''))) AS n{b}" for b in "ACGTN")
_STATS = f"SELECT count(*) AS n, sum(length(seq)) AS bases, min(length(seq)) AS lo, max(length(seq)) AS hi, {_COUNT} FROM reads"
_RC = "reverse(translate({}, 'ACGTacgt', 'TGCAtgca'))".format
_STRIP = "regexp_replace({}, '/[12]$', '')".format
_FIRST = "regexp_extract({}, '^[^ ]*', 0)".format
_N = _FIRST("name")
_DESC = "CASE WHEN name LIKE '% %' THEN substr(name, CAST(length(regexp_extract(name, '^[^ ]*', 0)) + 2 AS INT)) ELSE '' END"
_UUID = f"@RX({_N}, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')"
_PACBIO = f"@RX({_N}, '^m[^/]*[0-9][^/]*/[0-9]+/')"
_MGI = f"(@RX({_STRIP(_N)}, '^[A-Z]{{1,3}}[0-9]+L[0-9]') AND @RX({_STRIP(_N)}, 'L[0-9].*C') AND @RX({_STRIP(_N)}, 'L[0-9].*R'))"
_ILLUMINA = f"@RX(regexp_extract({_STRIP(_N)}, '^[^#]*', 0), '^([^:]*:){{3,}}[0-9]+:[0-9]+$')"
_TAG = f"@RX({_DESC}, '(runid|read|ch|start_time)=')"
_PLATFORM = f"CASE WHEN {_UUID} OR {_TAG} THEN 'nanopore' WHEN {_PACBIO} THEN 'pacbio' WHEN {_MGI} THEN 'mgi' WHEN {_ILLUMINA} THEN 'illumina' ELSE 'unknown' END"
_MATE_KEY = f"SELECT read_id, regexp_replace(n, '/[1-4]$', '') AS base, CASE WHEN @RX(n, '/[1-4]$') THEN substr(n, CAST(length(n) AS INT), 1) WHEN @RX(d, '^[1-4]:') THEN substr(d, 1, 1) ELSE '' END AS marker FROM (SELECT read_id, {_N} AS n, {_DESC} AS d FROM reads)"
_SPOT = "regexp_replace(regexp_extract(name, '^[^ \t]*', 0), '/[1-4]$', '')"
_KMER = lambda k, t="reads", c="seq": f"(SELECT read_id, i, substr({c}, i, {k}) AS f FROM (SELECT read_id, {c}, @EX(length({c}) - {k - 1})@ AS i FROM {t} WHERE length({c}) >= {k}))"
_CANON = f"(SELECT read_id, i, f, {_RC('f')} AS r, least(f, {_RC('f')}) AS canon FROM {{}} AS km WHERE f NOT LIKE '%N%')"
_C15 = _CANON.format(_KMER(15))
_C15O = _CANON.format(_KMER(15, "reads_overlap"))
_MIN = "(SELECT read_id, canon, i, CASE WHEN f <= r THEN 0 ELSE 1 END AS flip, row_number() OVER (PARTITION BY read_id ORDER BY canon, i) AS rn FROM {})".format
_PLAN = f"""SELECT o.read_id, m.canon, coalesce(m.flip, 0) AS flip,
  CASE WHEN m.canon IS NULL THEN 0 WHEN m.flip = 1 THEN length(o.seq) - (m.i - 1) - 15 ELSE m.i - 1 END AS anchor,
  CASE WHEN m.flip = 1 THEN {_RC('o.seq')} ELSE o.seq END AS oriented
  FROM reads_overlap o LEFT JOIN (SELECT * FROM {_MIN(_C15O)} AS x WHERE rn = 1) m ON o.read_id = m.read_id"""
#: Orientation and anchor of every read, by its smallest canonical k-mer.
CLUSTER_PLAN = _PLAN
_ORDERED = f"SELECT read_id, canon, flip, anchor, oriented, row_number() OVER (ORDER BY CASE WHEN canon IS NULL THEN 1 ELSE 0 END, canon, anchor DESC, oriented, read_id) AS pos FROM ({_PLAN})"
_PHREDS = f"SELECT read_id, qual, {binned('bin8')} AS rt FROM reads"
_DIFF = f"(SELECT read_id, abs(ascii(substr(qual, i, 1)) - ascii(substr(rt, i, 1))) AS d FROM (SELECT read_id, qual, rt, @EX(length(qual))@ AS i FROM ({_PHREDS})))"
_MD5N = "md5(concat(name, '|', seq, '|', qual))"
_PARTS = "SUM(CAST(ascii(substr(h, {0}, 1)) AS BIGINT) * 256 + ascii(substr(h, {1}, 1)))".format
_GROUPS = f"(SELECT read_id @DIV 100 AS group_id, count(*) AS n, sum(length(name)) AS nb, sum(length(seq)) AS sb, sum(length(qual)) AS qb FROM reads GROUP BY read_id @DIV 100)"
_ENT = "(SELECT substr(p, i, {k}) AS ctx, substr(p, i + {k}, 1) AS sym FROM (SELECT p, @EX(length(p) - {k})@ AS i FROM (SELECT concat(repeat('A', {k}), regexp_replace(seq, '[^ACGT]', ''@ALL)) AS p FROM reads) AS pp WHERE length(p) > {k}))".format
_TOK = "(SELECT read_id, t, @EX(len_t)@ AS i FROM (SELECT read_id, regexp_extract_all(name, '[0-9]+|[^0-9]+', 0) AS t, LEN(regexp_extract_all(name, '[0-9]+|[^0-9]+', 0)) AS len_t FROM reads))"
#: Window minimizers of canonical k-mers: of ten in a row the one with the
#: smallest digest, of equal ones the last; (h, pos, strand) is unpacked from one
#: string so that a single window function keeps the three together.
_SKETCH = """(SELECT read_id, substr(m, 1, 32) AS h, 1000000000000 - CAST(substr(m, 33, 13) AS BIGINT) AS pos, substr(m, 46, 1) AS strand FROM (
  SELECT read_id, i, m, lag(substr(m, 1, 32)) OVER (PARTITION BY read_id ORDER BY i) AS p FROM (
    SELECT read_id, i, min(concat(md5(canon), lpad(CAST(1000000000000 - i AS STRING), 13, '0'), CASE WHEN f = canon THEN '+' ELSE '-' END)) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m
    FROM {}) WHERE i >= 10) WHERE p IS NULL OR p <> substr(m, 1, 32))""".format
#: CTEs of the seed index: seeds; counts of a hash; the counts' histogram, whose
#: running sum tells from which count on hashes are among the floor(0.0002 *
#: distinct) most frequent, so no window spans all hashes; those hashes; and the
#: occurrences that stay, at most 512 of a hash in even strides.
_INDEXED = """seeds AS (SELECT * FROM {seeds} AS sk), counts AS (SELECT h, count(*) AS n FROM seeds GROUP BY h),
  total AS (SELECT CAST(floor(0.0002 * count(*)) AS BIGINT) AS k FROM counts), hist AS (SELECT n, count(*) AS c FROM counts GROUP BY n),
  cut AS (SELECT n, c, before, k FROM (SELECT n, c, sum(c) OVER (ORDER BY n DESC) - c AS before FROM hist) AS hb CROSS JOIN total WHERE before < k),
  frequent AS (SELECT h FROM (SELECT s.h, t.k - t.before AS room, t.c, row_number() OVER (PARTITION BY s.n ORDER BY s.h) AS rn FROM counts s JOIN cut t ON s.n = t.n) WHERE c <= room OR rn <= room),
  entries AS (SELECT h, read_id, pos, strand FROM (SELECT s.h, s.read_id, s.pos, s.strand, row_number() OVER (PARTITION BY s.h ORDER BY s.read_id, s.pos) AS rn, count(*) OVER (PARTITION BY s.h) AS n
    FROM seeds s LEFT JOIN frequent f ON s.h = f.h WHERE f.h IS NULL) WHERE (rn - 1) % CAST(ceil(n / 512.0) AS INT) = 0)""".format
#: The SQL of the sketches, and the view each reads.
SKETCH_SQL = {_SKETCH(_C15O): "reads_overlap", _SKETCH(_C15): "reads"}
_INDEX_O = _INDEXED(seeds=_SKETCH(_C15O))
_SHARED = "SELECT q.read_id AS q, t.read_id AS t, count(*) AS n FROM seeds q JOIN entries t ON q.h = t.h AND q.read_id <> t.read_id GROUP BY q.read_id, t.read_id HAVING count(*) >= 3"

#: Vote of the leading 16 names on the platform.
_VOTE = f"SELECT platform, {B('n')} AS n FROM (SELECT platform, n, row_number() OVER (ORDER BY n DESC, code) AS rn FROM (SELECT platform, count(*) AS n, min(CASE platform WHEN 'illumina' THEN 1 WHEN 'nanopore' THEN 2 WHEN 'pacbio' THEN 3 ELSE 4 END) AS code FROM (SELECT {_PLATFORM} AS platform FROM reads WHERE read_id < 16) WHERE platform <> 'unknown' GROUP BY platform)) WHERE rn = 1"
#: Group size from the leading 16 names: runs of one spot's names, the last only
#: if the table ends within them; all are as long, 2 to 4, and their marks differ.
GROUP_SIZE = f"""SELECT CAST(CASE WHEN count(*) > 0 AND min(n) = max(n) AND max(n) BETWEEN 2 AND 4 AND min(distinct_marks) = 1 THEN max(n) ELSE 1 END AS BIGINT) AS group_size FROM (
  SELECT run, count(*) AS n, CASE WHEN count(mark) = 0 OR count(DISTINCT mark) = count(*) THEN 1 ELSE 0 END AS distinct_marks, max(read_id) AS last FROM (
    SELECT read_id, mark, sum(new) OVER (ORDER BY read_id) AS run FROM (
      SELECT read_id, nullif(marker, '') AS mark, CASE WHEN base = lag(base) OVER (ORDER BY read_id) THEN 0 ELSE 1 END AS new FROM ({_MATE_KEY.replace("FROM reads)", "FROM {0} WHERE read_id < 16)")}) AS mk) AS mn) AS mr GROUP BY run) AS runs
  WHERE last < 15"""
#: Fixed values of the estimate: contexts, factors and bits by platform, bytes of a frame.
_CAL_SHORT, _CAL_QUAL, _RESIDUAL, _FRAME = 0.86, "CASE platform WHEN 'pacbio' THEN 0.83 WHEN 'nanopore' THEN 0.95 ELSE 0.94 END", "CASE platform WHEN 'pacbio' THEN 0.07 WHEN 'nanopore' THEN 0.28 ELSE 0.2 END", 52
PLANS: dict[str, str] = {
    # scans, sinks and reports
    "s05_lockstep_mates": "WITH mates AS (SELECT read_id, read_id @DIV 2 AS spot, read_id % 2 AS mate, seq FROM reads),"
    " spots AS (SELECT CASE WHEN a.spot IS NULL OR b.spot IS NULL THEN CAST(@ERROR(concat('unequal read counts at spot ', CAST(coalesce(a.spot, b.spot) AS STRING))) AS BIGINT) ELSE a.read_id END AS first_id, a.seq AS first_seq, b.read_id AS second_id, b.seq AS second_seq"
    " FROM (SELECT * FROM mates WHERE mate = 0) a FULL JOIN (SELECT * FROM mates WHERE mate = 1) b ON a.spot = b.spot)"
    " SELECT CASE WHEN member = 0 THEN first_id ELSE second_id END AS read_id, member, CASE WHEN member = 0 THEN first_seq ELSE second_seq END AS seq FROM spots CROSS JOIN (SELECT 0 AS member UNION ALL SELECT 1 AS member) AS m",
    "s06_interleaved_spots": f"SELECT read_id, read_id @DIV 4 AS spot_id, read_id % 4 AS member FROM reads",
    "s07_auto_layout": f"SELECT read_id, group_size, read_id @DIV group_size AS spot_id, read_id % group_size AS member FROM reads_spots CROSS JOIN ({GROUP_SIZE.format('reads_spots')}) AS g",
    "s08_scan_in_order": "SELECT read_id, name, seq, qual FROM reads ORDER BY read_id",
    "s11_sequence_only": "SELECT read_id, seq FROM reads",
    "s13_row_group_subset": "SELECT read_id, name FROM reads WHERE read_id @DIV 100 IN (1, 3)",
    "s18_fastq_text": "SELECT read_id, concat('@', name, chr(10), seq, chr(10), '+', chr(10), qual) AS record FROM reads",
    "s19_fasta_text": "SELECT read_id, concat('>', name, chr(10), seq) AS record FROM reads",
    "s29_report_tsv": f"SELECT concat(CAST(n AS STRING), chr(9), CAST(bases AS STRING), chr(9), CAST(lo AS STRING), chr(9), CAST(hi AS STRING)) AS line FROM ({_STATS})",
    # projections and predicates
    "p02_member_filter": "SELECT read_id, name FROM reads WHERE read_id % 2 = 1",
    "p03_row_group_filter": f"SELECT read_id @DIV 100 AS row_group, {B('count(*)')} AS reads FROM reads WHERE read_id @DIV 100 IN (0, 2, 5) GROUP BY read_id @DIV 100",
    "p04_header_join": f"SELECT read_id, CASE WHEN d = '' THEN n ELSE concat(n, ' ', d) END AS header FROM (SELECT read_id, {_N} AS n, {_DESC} AS d FROM reads)",
    "p05_strip_mate": f"SELECT read_id, {_STRIP('name')} AS base FROM reads",
    "p06_mate_key": _MATE_KEY,
    "p07_spot_base": f"SELECT read_id, {_SPOT} AS spot FROM reads",
    "p08_is_uuid": f"SELECT read_id, {_UUID} AS hit FROM reads",
    "p09_is_pacbio": f"SELECT read_id, {_PACBIO} AS hit FROM reads",
    "p10_is_mgi": f"SELECT read_id, {_MGI} AS hit FROM reads",
    "p11_is_illumina": f"SELECT read_id, {_ILLUMINA} AS hit FROM reads",
    "p12_contains_tag": f"SELECT read_id, {_TAG} AS hit FROM reads",
    "p13_platform": f"SELECT read_id, {_PLATFORM} AS platform FROM reads",
    **{f"p14_binning_{k}": f"SELECT read_id, {binned(k)} AS qual FROM reads" for k in BINS},
    "p15_acgt": "SELECT read_id, @RX(seq, '^[ACGT]*$') AS strict, translate(seq, 'ACGTacgt', '01230123') AS folded FROM reads",
    "p16_valid_record": "SELECT read_id, length(seq) = length(qual) AND name <> '' AS valid FROM reads",
    "p18_long_reads": f"SELECT CASE WHEN sum(length(seq)) @DIV count(*) > 500 THEN TRUE ELSE FALSE END AS long_reads FROM reads WHERE read_id < 256",
    "p20_exceptions": f"SELECT read_id, {B('i - 1')} AS pos, b FROM {_BASE} WHERE b NOT IN ('A', 'C', 'G', 'T')",
    "p21_slot_label": "SELECT read_id, regexp_extract(f, '_([RrIi]?[0-9]+)$', 1) AS label FROM (SELECT read_id, concat('sample_', CASE WHEN read_id % 3 = 0 THEN 'R1' WHEN read_id % 3 = 1 THEN 'i2' ELSE 'x' END) AS f FROM reads)",
    "p23_candidate_gates": f"SELECT platform, platform <> 'nanopore' AS overlap, platform <> 'nanopore' AS lzma, platform = 'nanopore' AS tile FROM (SELECT DISTINCT {_PLATFORM} AS platform FROM reads)",
    "p22_level_parameters": "SELECT level, greatest(1, least(11, level + 6)) AS seq_order, CASE WHEN level < 8 THEN 0 ELSE 13 END AS hash_order, CASE WHEN level < 8 THEN 0 ELSE 25 END AS hash_bits, CASE WHEN level <= 2 THEN 131072 WHEN level <= 4 THEN 262144 WHEN level <= 6 THEN 1048576 WHEN level <= 8 THEN 2097152 ELSE 4194304 END AS block_reads, level = 9 AS full_budget, CASE WHEN level <= 8 THEN 0 ELSE 1 END AS quality_chunks, CASE WHEN level <= 8 THEN 256 ELSE 768 END AS tile_band, CASE WHEN level <= 6 THEN 1 WHEN level = 7 THEN 2 ELSE 4 END AS tile_refs FROM (SELECT DISTINCT 1 + read_id % 9 AS level FROM reads)",
    # joins
    "j01_mate_zip": "SELECT a.spot, a.name AS name1, b.name AS name2, length(a.seq) = length(b.seq) AS same_len FROM (SELECT read_id @DIV 2 AS spot, name, seq FROM reads WHERE read_id % 2 = 0) a FULL OUTER JOIN (SELECT read_id @DIV 2 AS spot, name, seq FROM reads WHERE read_id % 2 = 1) b ON a.spot = b.spot",
    "j02_distortion_lockstep": f"SELECT round(avg(d), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(100.0 * count(CASE WHEN d > 0 THEN 1 END) / count(*), 6) AS pct FROM {_DIFF} AS x",
    "j03_distortion_by_name": f"SELECT {B('count(*)')} AS matched, {B('sum(CASE WHEN o.qual = r.rt THEN 1 ELSE 0 END)')} AS same FROM reads o JOIN (SELECT name, max_by(rt, read_id) AS rt FROM (SELECT read_id, name, {binned('bin4')} AS rt FROM reads) GROUP BY name) r ON o.name = r.name",
    "j04_shared_seeds": f"WITH seeds AS (SELECT * FROM {_SKETCH(_C15O)} AS sk) SELECT q, t, {B('n')} AS n FROM ({_SHARED.replace('JOIN entries t', 'JOIN seeds t')})",
    "j05_fanout_cap": f"WITH {_INDEX_O} SELECT h, read_id, {B('pos')} AS pos, strand FROM entries",
    "j06_repeat_filter": f"WITH {_INDEX_O} SELECT c.h, {B('c.n')} AS n FROM counts c LEFT JOIN frequent f ON c.h = f.h WHERE f.h IS NULL",
    "j07_unpermute": f"WITH o AS ({_ORDERED}) SELECT o.pos, r.read_id, r.seq = CASE WHEN o.flip = 1 THEN {_RC('o.oriented')} ELSE o.oriented END AS restored FROM o JOIN reads_overlap r ON o.read_id = r.read_id",
    "j10_as_of_chunk": f"SELECT read_id, {B('max(gstart)')} AS gstart FROM reads r JOIN (SELECT read_id AS gstart FROM reads WHERE read_id % 64 = 0) g ON g.gstart <= r.read_id AND g.gstart > r.read_id - 64 GROUP BY read_id",
    "j13_platform_mix": f"SELECT grp, {B('count(DISTINCT p)')} AS platforms, count(DISTINCT p) <= 1 AS consistent FROM (SELECT read_id % 5 AS grp, {_PLATFORM} AS p FROM reads) WHERE p <> 'unknown' GROUP BY grp",
    # aggregations
    "a01_content_stats": f"SELECT {B('n')} AS reads, {B('bases')} AS bases, {B('lo')} AS min_len, {B('hi')} AS max_len, {B('nA')} AS a, {B('nC')} AS c, {B('nG')} AS g, {B('nT')} AS t, {B('nN')} AS n, {B('bases - nA - nC - nG - nT - nN')} AS other, round((nG + nC) * 1.0 / nullif(nA + nC + nG + nT, 0), 9) AS gc, round(bases * 1.0 / nullif(n, 0), 9) AS mean_len FROM ({_STATS})",
    "a02_base_composition": f"SELECT b AS base, {B('count(*)')} AS n FROM {_BASE} GROUP BY b",
    "a03_quality_histogram": f"SELECT CAST(q AS INT) AS phred, {B('count(*)')} AS n FROM {_QUALS} GROUP BY q",
    "a04_bucketed_histogram": f"SELECT {B('q @DIV 5 * 5')} AS bucket, {B('count(*)')} AS n FROM {_QUALS} GROUP BY q @DIV 5 * 5",
    "a05_gc_fraction": f"SELECT round((nG + nC) * 1.0 / nullif(nA + nC + nG + nT, 0), 9) AS gc FROM ({_STATS})",
    "a06_mean_length": f"SELECT round(bases * 1.0 / nullif(n, 0), 9) AS mean_len FROM ({_STATS})",
    "a07_mean_quality": f"SELECT round(avg(q), 9) AS mean_quality FROM {_QUALS}",
    "a08_fixed_length": f"SELECT coalesce(lo = hi, TRUE) AS fixed FROM ({_STATS})",
    "a09_shares": f"SELECT group_id, round(100.0 * nb / nullif(total, 0), 6) AS pct_names, round(8.0 * sb / nullif(n, 0), 6) AS bits_per_read FROM {_GROUPS} AS g CROSS JOIN (SELECT sum(length(name)) AS total FROM reads) AS t",
    "a10_platform_vote": _VOTE,
    "a11_content_class": f"SELECT CASE WHEN l <= 500 THEN 'unknown' WHEN m >= 32 THEN 'pacbio' WHEN m <= 28 THEN 'nanopore' ELSE 'unknown' END AS platform FROM (SELECT avg(q) AS m, count(*) * 1.0 / count(DISTINCT read_id) AS l FROM {_QUALS})",
    "a12_platform_resolve": f"SELECT coalesce(f.platform, v.platform, CASE WHEN c.l <= 500 THEN 'unknown' WHEN c.m >= 32 THEN 'pacbio' WHEN c.m <= 28 THEN 'nanopore' ELSE 'unknown' END) AS platform, forced FROM (SELECT CAST(NULL AS STRING) AS platform, FALSE AS forced UNION ALL SELECT 'mgi' AS platform, TRUE AS forced) AS f CROSS JOIN (SELECT max(platform) AS platform FROM ({_VOTE})) AS v CROSS JOIN (SELECT avg(q) AS m, count(*) * 1.0 / count(DISTINCT read_id) AS l FROM {_QUALS} WHERE read_id < 16) AS c",
    "a14_multiset_digest": f"SELECT {B(_PARTS(1, 2))} AS d1, {B(_PARTS(3, 4))} AS d2, {B(_PARTS(5, 6))} AS d3 FROM (SELECT {_MD5N} AS h FROM reads)",
    "a15_stream_digests": "SELECT read_id, sha256(name) AS names, sha256(seq) AS sequence, sha256(qual) AS quality FROM reads",
    "a17_order2_entropy": f"SELECT round(sum(n * log2(t * 1.0 / n)), 6) AS bits FROM (SELECT ctx, sym, count(*) AS n, sum(count(*)) OVER (PARTITION BY ctx) AS t FROM {_ENT(k=2)} GROUP BY ctx, sym)",
    "a17_order8_entropy": f"SELECT round(sum(n * log2(t * 1.0 / n)), 6) AS bits FROM (SELECT ctx, sym, count(*) AS n, sum(count(*)) OVER (PARTITION BY ctx) AS t FROM {_ENT(k=8)} GROUP BY ctx, sym)",
    "a18_quality_entropy": f"SELECT round(sum(n * log2(t * 1.0 / n)), 6) AS bits FROM (SELECT p, q, count(*) AS n, sum(count(*)) OVER (PARTITION BY p) AS t FROM (SELECT q, coalesce(lag(q) OVER (PARTITION BY read_id ORDER BY i), 0) AS p FROM {_QUALS}) GROUP BY p, q)",
    "a19_kmer_duplication": f"SELECT {B('count(*)')} AS kmers, {B('count(DISTINCT f)')} AS distinct_kmers, round(1 - count(DISTINCT f) * 1.0 / nullif(count(*), 0), 9) AS duplication FROM (SELECT upper(f) AS f FROM {_KMER(15)} WHERE NOT @RX(f, '[^ACGTacgt]')) WHERE @RX(md5(f), '^0[0-3]')",
    "a20_estimate": f"""WITH sample AS (SELECT read_id, name, seq, qual FROM reads WHERE read_id < 300000),
      shape AS (SELECT count(*) AS n, sum(length(seq)) AS bases, sum(length(name) + length(seq) + length(qual) + 6) AS raw, sum(length(seq) - length(regexp_replace(seq, '[^ACGTacgt]', ''@ALL))) AS other FROM sample),
      grams AS (SELECT substr(p, i, 8) AS ctx, substr(p, i + 8, 1) AS sym FROM (SELECT p, @EX(length(p) - 8)@ AS i FROM (SELECT concat(repeat('A', 8), upper(regexp_replace(seq, '[^ACGTacgt]', ''@ALL))) AS p FROM sample) AS pp WHERE length(p) > 8)),
      seq_bits AS (SELECT sum(n * log2(t * 1.0 / n)) AS bits FROM (SELECT ctx, sym, count(*) AS n, sum(count(*)) OVER (PARTITION BY ctx) AS t FROM grams GROUP BY ctx, sym)),
      quals AS (SELECT q, coalesce(lag(q) OVER (PARTITION BY read_id ORDER BY i), 0) AS p FROM (SELECT read_id, i, ascii(substr(qual, i, 1)) AS q FROM (SELECT read_id, qual, @EX(length(qual))@ AS i FROM sample))),
      qual_bits AS (SELECT sum(n * log2(t * 1.0 / n)) AS bits FROM (SELECT p, q, count(*) AS n, sum(count(*)) OVER (PARTITION BY p) AS t FROM quals GROUP BY p, q)),
      kmers AS (SELECT upper(f) AS f FROM {_KMER(15, 'sample')} WHERE NOT @RX(f, '[^ACGTacgt]')),
      dup AS (SELECT coalesce(1 - count(DISTINCT f) * 1.0 / nullif(count(*), 0), 0) AS d FROM kmers WHERE @RX(md5(f), '^0[0-3]')),
      resolved AS (SELECT coalesce(max(platform), 'unknown') AS platform FROM ({_VOTE}) AS vt),
      parts AS (SELECT n, bases, raw, other, platform, d, s.bits + 8 * other AS sb, q.bits AS qb FROM shape CROSS JOIN seq_bits s CROSS JOIN qual_bits q CROSS JOIN dup CROSS JOIN resolved)
      SELECT {B('n')} AS sample_reads, {B('bases')} AS sample_bases, {B('raw')} AS raw_bytes, platform, round(d, 9) AS duplication,
      CAST(ceil(round(CASE WHEN bases @DIV n > 500 THEN bases * ((1 - d) * sb / bases + d * {_RESIDUAL}) ELSE sb * {_CAL_SHORT} END / 8.0, 4)) AS BIGINT) AS seq_bytes, CAST(ceil(round(qb / 8.0 * {_CAL_QUAL}, 4)) AS BIGINT) AS qual_bytes FROM parts""",
    "a21_projection": f"SELECT {B('sum(nb)')} AS names, {B('sum(sb)')} AS seqs, round(sum(nb + sb + qb) * (SELECT count(*) FROM reads) * 1.0 / nullif(sum(n), 0), 3) AS projected FROM {_GROUPS} AS g WHERE group_id < 3",
    "a22_redundant_binning": f"SELECT {B('count(DISTINCT q)')} AS levels, round(100.0 * sum(CASE WHEN q <> CASE WHEN q < 25 THEN 15 ELSE 37 END THEN 1 ELSE 0 END) / count(*), 6) AS pct_changed FROM {_QUALS}",
    "a23_distortion_per_read": f"SELECT read_id, round(avg(d), 6) AS mae, {B('max(d)')} AS worst FROM {_DIFF} AS x GROUP BY read_id",
    "a24_qualdelta": f"SELECT {B('count(*)')} AS nbases, {B('count(CASE WHEN d > 0 THEN 1 END)')} AS changed, round(avg(d), 6) AS mean_abs, round(sqrt(avg(d * d)), 6) AS rmse, {B('max(d)')} AS worst FROM {_DIFF} AS x",
    **{f"a25_group_size{suffix}": GROUP_SIZE.format(table) for suffix, table in (("", "reads"), ("_pairs", "reads_spots"))},
    "a26_spot_coherence": f"SELECT {B('count(*)')} AS spots, {B('count(CASE WHEN n > 1 THEN 1 END)')} AS mismatched, min(CASE WHEN n > 1 THEN spot END) AS first_bad FROM (SELECT read_id @DIV 2 AS spot, count(DISTINCT {_SPOT}) AS n FROM reads GROUP BY read_id @DIV 2)",
    "a27_column_vote": f"SELECT {B('pos')} AS pos, b AS base, {B('n')} AS votes FROM (SELECT pos, b, n, row_number() OVER (PARTITION BY pos ORDER BY n DESC, b) AS rn FROM (SELECT true_pos + i AS pos, b, count(*) AS n FROM (SELECT true_pos, i, substr(s, i, 1) AS b FROM (SELECT true_pos, CASE WHEN flipped = 1 THEN {_RC('seq')} ELSE seq END AS s, @EX(length(seq))@ AS i FROM reads_overlap)) WHERE b IN ('A', 'C', 'G', 'T') GROUP BY true_pos + i, b)) WHERE rn = 1",
    "a28_consensus_vote": f"SELECT {B('pos')} AS pos, {B('total')} AS votes, CASE WHEN total < 3 THEN 'draft' WHEN d > greatest(a, c, g, t) THEN '-' WHEN a >= greatest(c, g, t) THEN 'A' WHEN c >= greatest(g, t) THEN 'C' WHEN g >= t THEN 'G' ELSE 'T' END AS called FROM (SELECT true_pos + i AS pos, count(CASE WHEN b = 'A' THEN 1 END) AS a, count(CASE WHEN b = 'C' THEN 1 END) AS c, count(CASE WHEN b = 'G' THEN 1 END) AS g, count(CASE WHEN b = 'T' THEN 1 END) AS t, count(CASE WHEN b = '-' THEN 1 END) AS d, count(CASE WHEN b IN ('A', 'C', 'G', 'T', '-') THEN 1 END) AS total FROM (SELECT true_pos, i, CASE WHEN (read_id + i) % 5 < 2 THEN '-' ELSE substr(s, i, 1) END AS b FROM (SELECT read_id, true_pos, CASE WHEN flipped = 1 THEN {_RC('seq')} ELSE seq END AS s, @EX(length(seq))@ AS i FROM reads_overlap)) GROUP BY true_pos + i)",
    "a31_coverage": f"SELECT {B('d * 11 @DIV 2')} AS genome, {B('greatest(1, CAST(round(b * 1.0 / greatest(d * 11 @DIV 2, 1)) AS BIGINT) @DIV 40)')} AS stride FROM (SELECT count(DISTINCT h) AS d FROM {_SKETCH(_C15O)} AS sk) AS m CROSS JOIN (SELECT sum(length(seq)) AS b FROM reads_overlap) AS l",
    "a32_info_rollup": f"SELECT {B('count(*)')} AS groups, {B('sum(n)')} AS reads, {B('sum(nb)')} AS names_bytes, {B('sum(sb)')} AS seq_bytes, {B('sum(qb)')} AS qual_bytes FROM {_GROUPS} AS g",
    "a33_verify_rollup": f"SELECT CASE WHEN sum(CASE WHEN ok THEN 0 ELSE 1 END) = 0 THEN TRUE ELSE FALSE END AS passed, {B('sum(CASE WHEN ok THEN 0 ELSE 1 END)')} AS failed FROM (SELECT group_id, sb = qb AS ok FROM {_GROUPS} AS g)",
    "a34_recovery_tally": f"SELECT {B('sum(CASE WHEN group_id % 7 <> 3 THEN n ELSE 0 END)')} AS recovered, {B('count(CASE WHEN group_id % 7 = 3 THEN 1 END)')} AS skipped, {B('sum(CASE WHEN group_id % 7 = 3 THEN n ELSE 0 END)')} AS reads_lost FROM {_GROUPS} AS g",
    "a35_normalised_frequencies": "SELECT b, CAST(CASE WHEN rn = 1 THEN f + 4096 - total ELSE f END AS BIGINT) AS freq FROM (SELECT b, f, row_number() OVER (ORDER BY f DESC, b) AS rn, sum(f) OVER () AS total FROM (SELECT q AS b, greatest(1, count(*) * 4096 @DIV (SELECT sum(length(qual)) FROM reads)) AS f FROM " + _QUALS + " AS qq GROUP BY q))",
    "a36_benchmark_geomean": f"SELECT dataset, {B('count(*)')} AS n, round(exp(avg(ln(ratio))), 6) AS geomean FROM (SELECT group_id % 4 AS dataset, (nb + sb + qb) * 1.0 / sb AS ratio FROM {_GROUPS} AS g) GROUP BY dataset",
    # windows
    "w01_duplicate_of_previous": f"WITH o AS ({_ORDERED}) SELECT read_id, coalesce(oriented = lag(oriented) OVER (ORDER BY pos), FALSE) AS dup FROM o",
    "w02_token_delta": f"SELECT read_id, {B('i')} AS col, {TOKEN_OP_SQL} AS op, {TOKEN_VALUE_SQL} AS value FROM (SELECT read_id, i, t[i + @ZERO] AS k, last[i + @ZERO] AS p FROM (SELECT read_id, t, last, @EX(@LEN(t))@ AS i FROM (SELECT read_id, t, lag(t) OVER (ORDER BY read_id) AS last FROM (SELECT read_id, regexp_extract_all(name, '[0-9]+|[^0-9]+', 0) AS t FROM reads))))",
    "w03_runs": f"SELECT {B('run')} AS run, {B('count(*)')} AS n, min(read_id) AS first_read FROM (SELECT read_id, sum(new) OVER (ORDER BY read_id) AS run FROM (SELECT read_id, CASE WHEN {_PLATFORM} = lag({_PLATFORM}) OVER (ORDER BY read_id) THEN 0 ELSE 1 END AS new FROM reads)) GROUP BY run",
    "w04_row_groups": f"SELECT read_id @DIV 128 AS row_group, {B('count(*)')} AS reads, {B('sum(length(seq))')} AS bases FROM reads GROUP BY read_id @DIV 128",
    "w05_prefix_offsets": f"SELECT read_id, {B('sum(length(seq)) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(seq)')} AS start FROM reads",
    "w06_minimizers": f"SELECT read_id, {B('i')} AS i, h FROM (SELECT read_id, i, h, lag(h) OVER (PARTITION BY read_id ORDER BY i) AS p FROM (SELECT read_id, i, min(md5(f)) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h FROM {_KMER(15)}) WHERE i >= 10) WHERE p IS NULL OR p <> h",
    "w07_syncmers": f"SELECT read_id, {B('i')} AS i, f FROM (SELECT k.read_id, k.i, k.f, min(md5(substr(k.f, j, 5))) AS m FROM (SELECT read_id, i, f, @EX(11)@ AS j FROM {_KMER(15)}) k GROUP BY k.read_id, k.i, k.f) WHERE m = md5(substr(f, 1, 5)) OR m = md5(substr(f, 11, 5))",
    "w08_homopolymer": f"SELECT read_id, {B('i')} AS i, {B('least(7, count(*) OVER (PARTITION BY read_id, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS run FROM (SELECT read_id, i, sum(new) OVER (PARTITION BY read_id ORDER BY i) AS g FROM (SELECT read_id, i, CASE WHEN b = lag(b) OVER (PARTITION BY read_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM {_BASE}))",
    "w09_quality_context": f"SELECT read_id, {B('i')} AS i, CAST(q1 AS INT) AS q1, CAST(q2 @DIV 4 AS INT) AS q2, CAST(q3 @DIV 16 AS INT) AS q3, {B('least(3, sum(CASE WHEN q1 <> q2 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS delta FROM (SELECT read_id, i, coalesce(lag(q, 1) OVER w, 0) AS q1, coalesce(lag(q, 2) OVER w, 0) AS q2, coalesce(lag(q, 3) OVER w, 0) AS q3 FROM {_QUALS} WINDOW w AS (PARTITION BY read_id ORDER BY i))",
    "w10_rank_truncate": f"WITH {_INDEX_O} SELECT q, t, {B('n')} AS n FROM (SELECT q, t, n, row_number() OVER (PARTITION BY q ORDER BY n DESC, t) AS rn FROM ({_SHARED})) WHERE rn <= 512",
    "w11_equal_chunks": f"SELECT {B('least(7, (upto - len) * 8 @DIV total)')} AS chunk, {B('count(*)')} AS reads FROM (SELECT length(seq) AS len, sum(length(seq)) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(length(seq)) OVER () AS total FROM reads) GROUP BY least(7, (upto - len) * 8 @DIV total)",
    "w12_min_canonical": f"SELECT read_id, canon, {B('i - 1')} AS pos, flip FROM {_MIN(_C15)} AS m WHERE rn = 1",
    # sorts, limits and sets
    "o01_cluster_order": f"SELECT read_id, canon, flip, {B('anchor')} AS anchor, {B('pos')} AS pos FROM ({_ORDERED})",
    "o02_apply_order": f"SELECT {B('pos')} AS pos, read_id, oriented AS seq FROM ({_ORDERED})",
    "o03_sorted_anchors": f"WITH {_INDEXED(seeds=_SKETCH(_C15))} SELECT q, {B('count(*)')} AS anchors, {B('sum(rn * (tpos * 1000 + qpos))')} AS order_digest FROM (SELECT a.read_id AS q, b.pos AS tpos, a.pos AS qpos, row_number() OVER (PARTITION BY a.read_id ORDER BY b.read_id, a.strand = b.strand, b.pos, a.pos) AS rn FROM seeds a JOIN entries b ON a.h = b.h AND a.read_id <> b.read_id) GROUP BY q",
    "o04_distinct_count": f"SELECT {B('count(*)')} AS n FROM (SELECT DISTINCT canon FROM {_C15} AS c)",
    "o05_dual_cap": "SELECT read_id FROM (SELECT read_id, coalesce(sum(length(seq)) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM reads WHERE read_id < 300) WHERE seen < 16000",
    "o06_peek": "SELECT read_id, name FROM reads WHERE read_id < 16",
    "o07_occurrence_sort": f"SELECT canon, read_id, {B('i')} AS i, f = canon AS strand FROM {_C15} AS c ORDER BY canon, read_id, i",
    "o08_argmin": "SELECT group_id, CASE WHEN nb <= sb AND nb <= qb THEN 'names' WHEN sb <= qb THEN 'sequence' ELSE 'quality' END AS method, CAST(least(nb, sb, qb) AS BIGINT) AS bytes FROM " + _GROUPS + " AS g",
    "o09_candidate_cap": f"WITH {_INDEX_O} SELECT q, t, {B('n')} AS n, {B('rn')} AS place FROM (SELECT q, t, n, row_number() OVER (PARTITION BY q ORDER BY n DESC, t) AS rn FROM ({_SHARED}) WHERE n >= 4) WHERE rn <= 16",
    "o10_order_restore": f"SELECT read_id, {_RC('oriented')} AS rc FROM ({_ORDERED}) WHERE flip = 1 ORDER BY read_id",
    "u01_concatenate": "SELECT read_id, seq FROM reads WHERE read_id % 2 = 0 UNION ALL SELECT read_id, seq FROM reads WHERE read_id % 2 = 1",
    "u02_set_union": f"SELECT canon FROM {_C15} AS a UNION SELECT canon FROM {_C15O} AS b",
    "u03_multiset_equality": f"SELECT {B('count(*)')} AS differing FROM (SELECT seq FROM reads EXCEPT ALL SELECT {_RC(_RC('seq'))} FROM reads)",
    "u04_membership": f"WITH {_INDEX_O} SELECT s.read_id, s.h, {B('s.pos')} AS pos FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM frequent f WHERE f.h = s.h)",
    # scalar functions
    "f01_revcomp": f"SELECT read_id, {_RC('seq')} AS rc FROM reads",
    "f02_revcomp_acgt": "SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads",
    "f03_base_codes": f"SELECT read_id, {B('i')} AS i, CAST(CASE b WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 255 END AS INT) AS code FROM {_BASE} AS b",
    "f04_kmer_at": "SELECT read_id, CASE WHEN @RX(substr(seq, 11, 15), '^[ACGT]{15}$') THEN substr(seq, 11, 15) END AS kmer FROM reads",
    "f05_canonical_kmer": f"SELECT read_id, {B('i')} AS i, canon FROM {_C15} AS c",
    "f08_varint_size": f"SELECT read_id, CAST(CASE {' '.join(f'WHEN v < {1 << 7 * k} THEN {k}' for k in range(1, 9))} ELSE 9 END AS INT) AS bytes FROM (SELECT read_id, CAST(pow(2, read_id % 62) AS BIGINT) + read_id % 3 - 1 AS v FROM reads)",
    "f09_zigzag": f"SELECT read_id, {B('CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END')} AS z FROM (SELECT read_id, read_id % 13 - 6 AS d FROM reads)",
    "f10_tokenise": f"SELECT read_id, {B('i')} AS i, token, @RX(token, '^[0-9]{{1,18}}$') AS number FROM (SELECT read_id, i, t[i + @ZERO] AS token FROM (SELECT read_id, t, @EX(@LEN(t))@ AS i FROM (SELECT read_id, regexp_extract_all(concat(name, ':', repeat('7', CAST(16 + read_id % 6 AS INT))), '[0-9]+|[^0-9]+', 0) AS t FROM reads)))",
    "f11_zero_pad": "SELECT read_id, lpad(CAST(read_id AS STRING), CAST(greatest(6, length(CAST(read_id AS STRING))) AS INT), '0') AS padded FROM reads",
    "f12_template": f"SELECT read_id % 5 AS grammar, {B('count(DISTINCT t)')} AS shapes FROM (SELECT read_id, regexp_replace(name, '[0-9]+', '#'@ALL) AS t FROM reads) GROUP BY read_id % 5",
    "f13_renumber": "SELECT read_id, concat('SRR1.', CAST(read_id + 1 AS STRING)) AS name FROM reads",
    "f14_phred": f"SELECT read_id, {B('i')} AS i, CAST(q AS INT) AS q, chr(CAST(q + 33 AS INT)) AS c FROM {_QUALS} AS q",
    "f16_ratio": "SELECT group_id, round(CASE WHEN sb = 0 THEN 0 ELSE (nb + sb + qb) * 1.0 / sb END, 6) AS ratio FROM " + _GROUPS + " AS g",
    "f17_raw_bytes": f"SELECT {B('sum(length(name) + length(seq) + length(qual) + 6)')} AS raw_bytes FROM reads",
    "f18_size_format": "SELECT group_id, CASE WHEN v < 1000 THEN concat(CAST(v AS STRING), ' B') ELSE concat(CAST(v @DIV 1000 AS STRING), '.', lpad(CAST(v % 1000 @DIV 10 AS STRING), 2, '0'), ' KB') END AS size FROM (SELECT group_id, CAST(nb AS BIGINT) AS v FROM " + _GROUPS + " AS g)",
    "f19_slices_by_lengths": "SELECT group_id, nth, substr(whole, CAST(start AS INT), CAST(size AS INT)) AS seq FROM (SELECT read_id @DIV 2 AS group_id, read_id % 2 AS nth, length(seq) AS size, CASE WHEN read_id % 2 = 0 THEN 1 ELSE 1 + first_size END AS start, whole FROM reads JOIN (SELECT a.g AS g, length(a.seq) AS first_size, concat(a.seq, b.seq) AS whole FROM (SELECT read_id @DIV 2 AS g, seq FROM reads WHERE read_id % 2 = 0) a JOIN (SELECT read_id @DIV 2 AS g, seq FROM reads WHERE read_id % 2 = 1) b ON a.g = b.g) w ON read_id @DIV 2 = w.g)",
    "f29_member_labels": "SELECT group_id, CASE WHEN group_id % 4 = 0 OR group_id % 4 = 3 THEN '' ELSE concat('R', CAST(group_id % 4 AS STRING)) END AS label, CASE WHEN group_id % 4 = 0 OR group_id % 4 = 3 THEN FALSE ELSE TRUE END AS kept FROM " + _GROUPS + " AS g",
    "f20_gap_cost": "SELECT read_id, CAST(CASE WHEN g = 0 THEN 0 ELSE floor(0.01 * 15 * g + 0.5 * log2(g)) END AS INT) AS cost FROM (SELECT read_id, read_id % 500 AS g FROM reads)",
    "f21_mismatches": f"SELECT read_id, {B('sum(CASE WHEN x <> y THEN 1 ELSE 0 END)')} AS mism FROM (SELECT a.read_id, substr(a.seq, a.i, 1) AS x, substr(a.rc, a.i, 1) AS y FROM (SELECT read_id, seq, {_RC('seq')} AS rc, @EX(length(seq))@ AS i FROM reads) a) GROUP BY read_id",
    "f22_edit_distance": f"SELECT a.read_id, {B('levenshtein(a.seq, b.seq)')} AS d FROM reads_overlap a JOIN (SELECT read_id - 1 AS p, seq FROM reads_overlap) b ON a.read_id = b.p",
    "f27_fit_order": f"SELECT CAST(least(11, floor(log2(bases) / 2)) AS INT) AS k FROM ({_STATS})",
    "f28_flip_bit": f"SELECT read_id, flip = 1 AS flipped, {B('read_id @DIV 8')} AS byte, {B('read_id % 8')} AS bit FROM ({_PLAN})",
    # size models of the codecs
    "c01_name_streams": f"SELECT {B('col')} AS col, {B('count(*)')} AS tokens, {B("count(CASE WHEN op = 'MATCH' THEN 1 END)")} AS matches, {B("count(CASE WHEN op = 'DELTA' THEN 1 END)")} AS deltas, {B("count(CASE WHEN op = 'NUM' THEN 1 END)")} AS numbers, {B("count(CASE WHEN op = 'STR' THEN 1 END)")} AS strings, {B('sum(length(value) + 1)')} AS payload FROM (@w02) AS w GROUP BY col",
    "c16_method_contest": f"SELECT group_id, CASE WHEN packed < order_k THEN 'packed' ELSE 'order-k' END AS method, CAST(least(packed, order_k) AS BIGINT) AS bytes FROM (SELECT group_id, sum(ceil(length(seq) / 4.0) + 2 * (length(seq) - length(replace(seq, 'N', '')))) AS packed FROM (SELECT read_id @DIV 100 AS group_id, seq FROM reads) GROUP BY group_id) p JOIN (SELECT g, ceil(round(sum(n * log2(t * 1.0 / n)) / 8, 4)) AS order_k FROM (SELECT g, ctx, sym, count(*) AS n, sum(count(*)) OVER (PARTITION BY g, ctx) AS t FROM (SELECT g, substr(p, i, 2) AS ctx, substr(p, i + 2, 1) AS sym FROM (SELECT g, p, @EX(length(p) - 2)@ AS i FROM (SELECT read_id @DIV 100 AS g, concat('AA', regexp_replace(seq, '[^ACGT]', ''@ALL)) AS p FROM reads) AS pq WHERE length(p) > 2)) GROUP BY g, ctx, sym) GROUP BY g) k ON p.group_id = k.g",
    "text_duplicates": f"SELECT min(read_id) AS first_read, {B('count(*)')} AS n FROM reads_text WHERE seq IS NOT NULL GROUP BY md5(seq) HAVING count(*) > 1",
}
PLANS["c01_name_streams"] = PLANS["c01_name_streams"].replace("@w02", PLANS["w02_token_delta"])
