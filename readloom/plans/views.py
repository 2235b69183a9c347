"""The reads views and the two SQL dialects that plans are written in.

A plan is one SQL text over ``reads`` and its kin. Tokens stand for what Spark
and DuckDB spell differently: ``@EX(n)@`` counts 1 to n in rows, ``@RX`` is
the regular-expression test, ``@DIV`` divides integers, ``@ALL`` makes
``regexp_replace`` replace every match, ``@ARR`` joins an array to a string,
``@ERROR(text)`` stops the query, and ``@S'..'`` is a literal without escapes.
"""

from __future__ import annotations

import hashlib
import re

#: 4096 bases that overlapping reads are cut from, made by a rule.
GENOME = "".join(hashlib.md5(b"genome%d" % i).hexdigest() for i in range(128)).translate(str.maketrans("0123456789abcdef", "ACGTACGTCAGTTGCA"))

_SEQ = "translate(concat(md5(concat('s', CAST(event_id % 200 AS STRING))), md5(concat('t', CAST(event_id % 200 AS STRING)))), '0123456789abcdef', 'ACGTACGTACGTACGN')"
_QUAL = "translate(concat(md5(concat('q', CAST(event_id AS STRING))), md5(concat('r', CAST(event_id AS STRING)))), '0123456789abcdef', '#+0:?DIII?:0+##!')"
_ID = "CAST(event_id AS STRING)"
_MD = f"md5(concat('u', {_ID}))"
_NAME = f"""CASE event_id % 5
  WHEN 0 THEN concat('INST:1:FC:2:1101:', CAST(event_id * 7 % 1000 AS STRING), ':', {_ID}, ' 1:N:0:ACGT')
  WHEN 1 THEN concat('m64_1/', {_ID}, '/ccs')
  WHEN 2 THEN concat('V300L1C001R001', {_ID}, '/', CAST(1 + event_id % 2 AS STRING))
  WHEN 3 THEN concat(substr({_MD}, 1, 8), '-', substr({_MD}, 9, 4), '-', substr({_MD}, 13, 4), '-', substr({_MD}, 17, 4), '-', substr({_MD}, 21, 12), ' runid=x')
  ELSE concat('SRR1.', {_ID}, ' ', {_ID}, ' length=64') END"""
_CUT = f"substr('{GENOME}', CAST(1 + event_id * 37 % 3996 AS INT), 100)"
_SUBST = f"concat(substr({_CUT}, 1, CAST(event_id % 97 AS INT)), 'A', substr({_CUT}, CAST(event_id % 97 + 2 AS INT), 100))"

#: A token that is coded as a number: at most 18 digits, the first not zero
#: unless it is alone.
_NUMBER = "@RX({0}, '^(0|[1-9][0-9]{{0,17}})$')".format
TOKEN_OP_SQL = f"CASE WHEN p IS NOT NULL AND k = p THEN 'MATCH' WHEN {_NUMBER('k')} AND p IS NOT NULL AND {_NUMBER('p')} THEN 'DELTA' WHEN {_NUMBER('k')} THEN 'NUM' ELSE 'STR' END"
_STEP = "(CAST(k AS BIGINT) - CAST(p AS BIGINT))"
TOKEN_VALUE_SQL = f"CASE WHEN p IS NOT NULL AND k = p THEN '' WHEN {_NUMBER('k')} AND p IS NOT NULL AND {_NUMBER('p')} THEN CAST(CASE WHEN {_STEP} >= 0 THEN 2 * {_STEP} ELSE -2 * {_STEP} - 1 END AS STRING) ELSE k END"

VIEWS = {
    "reads": f"SELECT event_id AS read_id, {_NAME} AS name, {_SEQ} AS seq, {_QUAL} AS qual FROM events",
    "reads_overlap": f"SELECT event_id AS read_id, event_id * 37 % 3996 AS true_pos, event_id % 2 AS flipped, CASE WHEN event_id % 2 = 1 THEN reverse(translate({_SUBST}, 'ACGT', 'TGCA')) ELSE {_SUBST} END AS seq FROM events",
    "reads_spots": f"SELECT event_id AS read_id, concat('SPOT.', CAST(event_id @DIV 2 AS STRING), '/', CAST(1 + event_id % 2 AS STRING)) AS name, {_SEQ} AS seq, {_QUAL} AS qual FROM events",
    "contigs": f"SELECT s_suppkey AS id, {_SUBST.replace('event_id', 's_suppkey')} AS seq FROM supplier",
    "reads_text": "SELECT doc_id AS read_id, text AS seq FROM documents",
}

#: Quality tables as (from, to) for Phred 0 to 93, offset 33.
PHRED = [chr(33 + q) for q in range(94)]


def _steps(*steps: tuple[int, int]) -> list[int | None]:
    """Table of Phred values: from each first value on, the second; -1 keeps."""
    out = []
    for q in range(94):
        to = [t for f, t in steps if f <= q][-1]
        out.append(q if to < 0 else to)
    return out


#: Phred from which a bin begins, and what it becomes.
BINS = {
    "bin8": _steps((0, -1), (2, 6), (10, 15), (20, 22), (25, 27), (30, 33), (35, 37), (40, 40)),
    "bin4": _steps((0, 2), (3, 12), (18, 24), (30, 40)),
    "bin2": _steps((0, 15), (25, 37)),
    "ont": _steps((0, 3), (7, 10), (14, 18), (26, 35)),
    "hifi": _steps((0, 3), (7, 10), (14, 18), (26, 35), (93, 93)),
}


def binned(table: str, column: str = "qual") -> str:
    """SQL of a quality string under a table."""
    quote = lambda s: s.replace("'", "''")
    chars = [(a, chr(33 + q)) for a, q in zip(PHRED, BINS[table], strict=True)]
    chars = [(a, b) for a, b in chars if a != b]
    source, target = "".join(a for a, _ in chars), "".join(b for _, b in chars)
    return f"translate({column}, @S'{quote(source)}', @S'{quote(target)}')"


#: A literal that is taken as it stands, backslashes and all.
_PLAIN = r"@S'((?:[^']|'')*)'"


def _with_views(sql: str) -> str:
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    return f"WITH {head}, {body[4:].lstrip()}" if body.upper().startswith("WITH") else f"WITH {head} {body}"


def to_duckdb(sql: str) -> str:
    sql = re.sub(r"@EX\((.*?)\)@", r"unnest(range(1, CAST(\1 AS BIGINT) + 1))", _with_views(sql))
    sql = re.sub(_PLAIN, r"'\1'", sql)
    return sql.replace("@ERROR", "error").replace("@RX", "regexp_matches").replace("@DIV", "//").replace("@ALL", ", 'g'").replace("@ARR", "array_to_string").replace("@ZERO", "0").replace("@LEN", "len")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def to_spark(sql: str, sf_dir: str) -> str:
    sql = re.sub(r"@EX\((.*?)\)@", r"explode(sequence(1, CAST(\1 AS INT)))", _with_views(sql))
    sql = sql.replace("@ERROR", "raise_error").replace("@RX", "regexp_like").replace("@DIV", "DIV").replace("@ALL", "").replace("@ARR", "array_join").replace("@ZERO", "(-1)").replace("@LEN", "size")
    sql = re.sub(r"sha256\((\w+)\)", r"sha2(\1, 256)", sql)
    sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1D", sql)
    sql = re.sub(_PLAIN, lambda m: "'" + m[1].replace("\\", "\\\\").replace("''", "\\'") + "'", sql)
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` AS {m[2]}", sql)
