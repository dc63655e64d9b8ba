"""Fill-in-the-middle: texts cut in three and rearranged around sentinels, in DataFrame functions only.

A text's units are its lines, each with its line feed. Two cuts of the units give
prefix, middle and suffix; psm writes prefix, suffix, middle, spm suffix, prefix,
middle, each part behind its sentinel. Everything random comes from the sha256 of
``seed:id``, so that a row's cuts and form depend on nothing else and reruns agree.

Defined results: a null text counts as empty; an empty text and one that contains a
sentinel stay plain, since nothing could tell them from what is written here; a null
id draws as the empty string; repeated rows draw alike; a text of one unit may have
empty parts; extra columns pass, but for those that are made here, which are
replaced; an empty table gives no row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, from 1, as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, units: str = LINES) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output; rate and spm are percentages."""
    own = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    cut = docs.drop(*MADE).withColumns({"_fim_units": F.regexp_extract_all(own, F.lit(units), 0), "_fim_digest": digest})
    n = F.size("_fim_units").cast("long")
    one, two = (draw(F.col("_fim_digest"), k) % (n + 1) for k in (1, 2))
    cut = cut.withColumns({"n": n, "_fim_low": F.least(one, two).cast("int"), "_fim_high": F.greatest(one, two).cast("int")})
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(own, F.lit(mark))
    plain = (own == "") | marked | (draw(F.col("_fim_digest"), 3) % 100 >= rate)
    cut = cut.withColumn("form", F.when(plain, "plain").when(draw(F.col("_fim_digest"), 4) % 100 < spm, "spm").otherwise("psm"))
    part = lambda begin, size: F.array_join(F.slice("_fim_units", begin, size), "")
    low, high = F.col("_fim_low"), F.col("_fim_high")
    parts = cut.withColumns({"_fim_p": part(1, low), "_fim_m": part(low + 1, high - low), "_fim_s": part(high + 1, F.size("_fim_units") - high)})
    psm = F.concat(F.lit(PREFIX), "_fim_p", F.lit(SUFFIX), "_fim_s", F.lit(MIDDLE), "_fim_m")
    spm_ = F.concat(F.lit(SUFFIX), "_fim_s", F.lit(PREFIX), "_fim_p", F.lit(MIDDLE), "_fim_m")
    form, made = F.col("form"), F.col("form") != "plain"
    out = parts.withColumns({"prefix_chars": F.when(made, F.length("_fim_p").cast("long")), "middle_chars": F.when(made, F.length("_fim_m").cast("long")), "output": F.when(form == "plain", own).when(form == "psm", psm).otherwise(spm_)})
    return out.drop("_fim_units", "_fim_digest", "_fim_low", "_fim_high", "_fim_p", "_fim_m", "_fim_s")


def restore(output: Column, form: Column) -> Column:
    """The text of an output by its sentinels alone; null where these are not as the form has them.

    Parts hold no sentinel, and none can arise where a part and a sentinel meet: a
    sentinel's first letter stands nowhere else in it.
    """
    found = F.split(output, f"{re.escape(PREFIX)}|{re.escape(SUFFIX)}|{re.escape(MIDDLE)}", -1)
    part = lambda k: F.get(found, F.lit(k))
    order = lambda first, second: F.startswith(output, F.lit(first)) & (F.size(found) == 4) & (F.instr(output, second) < F.instr(output, MIDDLE))
    psm = F.when(order(PREFIX, SUFFIX), F.concat(part(1), part(3), part(2)))
    spm = F.when(order(SUFFIX, PREFIX), F.concat(part(2), part(3), part(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


_NUMBER = "CAST('0x' || substr(d, {at}, 8) AS BIGINT)"
_H = [_NUMBER.format(at=8 * k + 1) for k in range(4)]
#: The digest columns that the query returns, in DuckDB's SQL.
ORACLE = f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
b AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {_H[0]} % (len(u) + 1) AS x, {_H[1]} % (len(u) + 1) AS y FROM a),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {_H[2]} % 100 >= 100 THEN 'plain' WHEN {_H[3]} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m, coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') AS s FROM b),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS w FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars, sha256(w) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN w ELSE p || m || s END) AS restored_sha256 FROM o"""
