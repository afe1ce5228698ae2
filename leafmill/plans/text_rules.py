"""Text rules over every line of the documents and over literal lines in a manual's wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from . import query
from .base import literal, t, values

LITERALS = [
    "Tighten to 22 Nem (2.2 kg~m, 16 Ib-ft)", "73 N·m (7.3 kg-m, 53 lb-ft)", "10 Nm (1.0 kg-rn, 7 lb—ft)", "10 x 1.25 mm", "8x1.25mm bolt", "clearance 0.18 – 0.22 mm", "@ Remove the belt",
    "D1i5B8 engine", "D15B7, D15B8 engine:", "engine D16Z6 with M/T", "D1SZ1 A/T", "D16Y8", "D 15 B 7", "D15Q7", "Heater Heater Heater", "Cylinder Head Cylinder Head", "Removal", "Illustrated Index", "Valve Clearance Adjustment",
    "Timing Belt — Replacement (cont'd) ====", "r Relay Test", "39.057 (1.4196)", "0.18 - 0.22 (0.007 - 0.009)", "92.95 - 93.05 (3.659 - 3.663)", "38.53", "-- --", "—", "|lift_", "Part No. 08718 - 0001 liquid gasket", "Part No. 08718-0001", "indicates code 14: EGR valve .",
    "O7742-0010100", "07HAH-PJ7010B", "07 742 0010100", "CAUTION: hot", "NOTE use new gaskets", "1. Remove the bolts.", "• Check the seal", "Qual o torque da admissão?", "folga do escape", "admissão e escape", "código 7 piscando", "Code 41", "which part 08718-0001 or tool 07742-0010100", "Junta do cabeçote e cabeçote", "troca da correia dentada",
    "[p. 6-3] see [p. 6-4, 9-12]", "Section 6 · p. 6-3, 6-4] text", "20 °C and 30° C", "5�C", "Remove the P/S belt and pump", "3.5 V 1,200 rpm 45-50 psi", "Ss", "~> 12 lb-ft_",
]
_SQL = f"""
lines AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  UNION ALL SELECT -id, 1, line FROM {values([(i, x) for i, x in enumerate(LITERALS, 1)], "id, line")})"""
ID = ["doc_id", "pos"]


def lines(spark, sf_dir):
    """(doc_id, pos, line): all lines of all documents, and the literal lines under negative ids."""
    own = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint") + 1)
    return own.unionByName(literal(spark, [(-i, 1, x) for i, x in enumerate(LITERALS, 1)], "doc_id long, pos long, line string"))


def rules(body: str) -> str:
    return f"WITH {_SQL} {body}"


_FIXES = "x"
for _bad, _good in X.ENGINE_FIX.items():
    _FIXES = f"replace({_FIXES}, '{_bad}', '{_good}')"
_NEAR = "list_filter(['D15B7', 'D15B8', 'D15Z1', 'D16Z6'], lambda e: length(e) = length(k) AND hamming(e, CASE WHEN length(k) = 5 THEN k ELSE 'D15B7' END) = 1)"
_KNOWN = "CASE k " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.ENGINE_FIX.items()) + " END"


#: The other engine's own rules: it can't look around, so what stands beside is captured and put back.  A digit between two dashes is captured by one
#: of them only, so that rule goes over a line twice.
_MENDED = [
    (r"^\s*[@\x{FFFD}©®]\s+", "• "),
    (r"([0-9])\s*N(m|\s?[e*.•·°o-]\s?m)\b", r"\1 N·m"),
    (r"([0-9])\s*(l|I|i|W|1|\|)b\s?(-|–|—)\s?ft\b", r"\1 lb-ft"),
    (r"([0-9])\s*kg\s?(-|–|—|~)\s?(m|rn)\b", r"\1 kg-m"),
    (r"([0-9])\s?[—–\x{FFFD}~]\s?([0-9])", r"\1-\2"),
    (r"([0-9])\s?[—–\x{FFFD}~]\s?([0-9])", r"\1-\2"),
    (r"\b([0-9]{1,2})\s?[xX×]\s?([0-9]\.[0-9]{1,2}) ?mm\b", r"\1 x \2 mm"),
    (r"([0-9])\s?°\s?C\b", r"\1 °C"),
    (r"([0-9])\x{FFFD}\s?([CF])\b", r"\1 °\2"),
]

_RULED = "line"
for _p, _r in _MENDED:
    _RULED = f"regexp_replace({_RULED}, '{_p}', '{_r}', 'g')"


@query(rules(rf"""
SELECT doc_id, pos, trim(regexp_replace(x, '[ \t]{{2,}}', ' ', 'g')) AS normal FROM (
  SELECT doc_id, pos, {_FIXES} AS x FROM (
    SELECT doc_id, pos, array_to_string(list_transform(list_zip(regexp_split_to_array(r, '\bD\s?[1Il]\s?[5S6]\s?[A-Z1-9]\s?[0-9]\b'),
        list_transform(regexp_extract_all(r, '\bD\s?[1Il]\s?[5S6]\s?[A-Z1-9]\s?[0-9]\b'), lambda m: replace(m, ' ', ''))), lambda z: z[1] || coalesce(
        CASE WHEN z[2] IN ('D15B7', 'D15B8', 'D15Z1', 'D16Z6') THEN z[2] END, {_KNOWN.replace('CASE k', 'CASE z[2]')},
        CASE WHEN len({_NEAR.replace('length(k)', 'length(z[2])').replace('THEN k', 'THEN z[2]')}) = 1 THEN ({_NEAR.replace('length(k)', 'length(z[2])').replace('THEN k', 'THEN z[2]')})[1] END, z[2], '')), '') AS x
    FROM (SELECT doc_id, pos, {_RULED} AS r FROM lines)))"""))
def normalised_lines(spark, sf_dir):
    """Recognised text put right by rules that look at what stands around."""
    return lines(spark, sf_dir).select(*ID, F.trim(X.normalised(F.col("line"))).alias("normal"))


@query(rules(r"""SELECT doc_id, pos, len(regexp_replace(line, '[^A-Za-z0-9]', '', 'g')) AS alnum, len(line) < 90 AND NOT suffix(line, '.') AND NOT regexp_matches(line, '^[0-9]+\.') AS heading,
  len(regexp_replace(line, '[^A-Za-z0-9]', '', 'g')) < 2 OR (pos % 100 < 70 AND NOT regexp_matches(line, '[0-9]|[A-Z]{3}')) AS junk FROM lines WHERE len(regexp_replace(line, '[^A-Za-z0-9]', '', 'g')) >= 2 AND (pos % 100 >= 55 OR pos = 1)"""))
def page_blocks(spark, sf_dir):
    """Blocks of a page in reading order, without junk and unsure lines."""
    alnum = F.length(F.regexp_replace("line", "[^A-Za-z0-9]", ""))
    kept = lines(spark, sf_dir).where((alnum >= 2) & ((F.col("pos") % 100 >= 55) | (F.col("pos") == 1)))
    return kept.select(*ID, alnum.cast("bigint").alias("alnum"), X.is_heading(F.col("line")).alias("heading"), X.is_junk(F.col("line"), F.col("pos") % 100).alias("junk"))


@query(rules(r"""SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^(.+)$') THEN
  coalesce((SELECT array_to_string(w[1:k], ' ') FROM (SELECT unnest(range(1, len(w) // 2 + 1)) AS k) WHERE len(w) % k = 0 AND list_filter(range(1, len(w) + 1), lambda i: w[i] <> w[(i - 1) % k + 1]) = [] ORDER BY k LIMIT 1), array_to_string(w, ' ')) ELSE '' END AS title
FROM (SELECT doc_id, pos, line, regexp_split_to_array(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') AS w FROM lines WHERE length(line) < 120)"""))
def collapsed_titles(spark, sf_dir):
    """Titles that repeat one unit."""
    return lines(spark, sf_dir).where(F.char_length("line") < 120).select(*ID, X.collapsed(F.col("line")).alias("title"))


@query(rules(r"""SELECT doc_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\(?\s*cont[’''`]?\s?d\s*\)?', '', 'g'), '^[^\p{L}\p{N}\p{M}]+', ''), '^[a-zA-Z]\s+([A-Z])', '\1'), '\s+', ' ', 'g'), ' -—–~:') AS heading,
  regexp_matches(t, '(?i)\(?\s*cont[’''`]?\s?d\s*\)?') AS continued FROM (SELECT doc_id, pos, regexp_replace(line, '[—–_~=£|]{2,}.*$', '') AS t FROM lines)"""))
def clean_headings(spark, sf_dir):
    """Headings without frames, junk and continuation marks."""
    title, contd = X.clean_heading(F.col("line"))
    return lines(spark, sf_dir).select(*ID, title.alias("heading"), contd.alias("continued"))


_CASES = " ".join(f"WHEN contains(lower(line), '{k}') THEN '{v}'" for k, v in X.OPERATIONS)


@query(rules(rf"""SELECT doc_id, pos, CASE {_CASES} ELSE 'other' END AS kind, list_sort(list_distinct(regexp_extract_all(line, '\b(D15B7|D15B8|D15Z1|D16Z6)\b', 1))) AS engines,
  list_filter([CASE WHEN regexp_matches(line, '\bM/T\b') THEN 'MT' END, CASE WHEN regexp_matches(line, '\bA/T\b') THEN 'AT' END], lambda x: x IS NOT NULL) AS trans FROM lines"""))
def title_attributes(spark, sf_dir):
    """What kind of procedure a title names, and to which engines and transmissions it applies."""
    engines, trans = X.applicability(F.col("line"))
    return lines(spark, sf_dir).select(*ID, X.operation(F.col("line")).alias("kind"), engines.alias("engines"), trans.alias("trans"))


_FOLD = "translate(lower(line), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy')"


@query(rules(rf"""SELECT doc_id, pos, CASE WHEN regexp_matches(q, 'admiss|intake') AND NOT regexp_matches(q, 'escape|exhaust') THEN 'IN' WHEN regexp_matches(q, 'escape|exhaust') AND NOT regexp_matches(q, 'admiss|intake') THEN 'EX' END AS side,
  regexp_extract_all(upper(line), '\b[0-9]{{5}}-[0-9]{{4}}\b|\b[0-9]{{5}}-[A-Z0-9]{{3}}-[A-Z0-9]{{2,4}}\b') AS part_numbers, regexp_extract_all(upper(line), '\b07[A-Z0-9]{{3}}-[A-Z0-9]{{6,7}}\b') AS tool_numbers,
  regexp_extract_all(line, '(?i)\b(?:c[oó]digo|code)\s*([0-9]{{1,2}})\b', 1) AS blink, list_sort(list_distinct(list_transform(regexp_extract_all(upper(line), '\bD\s?1[0-9]\s?[A-Z]\s?[0-9]\b'), lambda x: regexp_replace(x, '\s', '', 'g')))) AS engines
FROM (SELECT *, {_FOLD} AS q FROM lines)"""))
def question_codes(spark, sf_dir):
    """Literal codes of a question and the side that it asks about."""
    line = F.col("line")
    return lines(spark, sf_dir).select(*ID, X.side(line).alias("side"), *(v.alias(k) for k, v in X.codes(line).items()))


@query(rules(r"""SELECT doc_id, pos, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(upper(line), '\bD\s?1[0-9]\s?[A-Z]\s?[0-9]\b'), lambda x: regexp_replace(x, '\s', '', 'g'))), lambda x: x NOT IN ('D15B7', 'D15B8', 'D15Z1', 'D16Z6'))) AS foreign_engines,
  regexp_matches(line, '(?i)^\s*(n[ãa]o consta|n[ãa]o encontr)') AND length(line) < 220 AS says_not_found FROM lines"""))
def scope_guard(spark, sf_dir):
    """Engines out of scope refuse a question; short answers that say they found nothing are refusals."""
    line = F.col("line")
    foreign = F.array_except(X.codes(line)["engines"], F.array(*map(F.lit, X.ENGINES)))
    return lines(spark, sf_dir).select(*ID, F.array_sort(foreign).alias("foreign_engines"), (line.rlike(r"(?i)^\s*(n[ãa]o consta|n[ãa]o encontr)") & (F.char_length(line) < 220)).alias("says_not_found"))


_TQ = r"([0-9]+(?:\.[0-9]+)?) N·m \(([0-9]+(?:\.[0-9]+)?) kg-m,? ([0-9]+(?:\.[0-9]+)?) lb-ft\)"


@query(rules(rf"""SELECT doc_id, pos, nullif(regexp_extract(line, '{_TQ}', 0), '') AS value_text, TRY_CAST(nullif(regexp_extract(line, '{_TQ}', 1), '') AS DOUBLE) AS nm, TRY_CAST(nullif(regexp_extract(line, '{_TQ}', 3), '') AS DOUBLE) AS lbft,
  CASE WHEN regexp_matches(line, '^([0-9]{{1,2}}) x ([0-9](?:\.[0-9]{{1,2}})?) mm$') THEN line END AS fastener FROM lines"""))
def torque_lines(spark, sf_dir):
    """Torques and threads of a line."""
    q = X.torque(F.col("line"))
    return lines(spark, sf_dir).select(*ID, q["value_text"].alias("value_text"), q["nm"].alias("nm"), q["lbft"].alias("lbft"), X.fastener(F.col("line")).alias("fastener"))


_NUM = r"[0-9,]*\.?[0-9]+"
_RG = rf"^\s*({_NUM})(?:\s*-\s*({_NUM}))?\s*(?:\(\s*({_NUM})(?:\s*-\s*({_NUM}))?\s*\))?"
_G = [f"TRY_CAST(replace(nullif(regexp_extract(line, '{_RG}', {g}), ''), ',', '') AS DOUBLE)" for g in range(1, 5)]


@query(rules(rf"""SELECT doc_id, pos, lo, hi, coalesce(in_lo IS NOT NULL AND ((lo <> 0 AND abs(lo / 25.4 - in_lo) > greatest(0.0006, 0.012 * in_lo)) OR (hi IS NOT NULL AND hi <> 0 AND in_hi IS NOT NULL AND in_hi <> 0 AND abs(hi / 25.4 - in_hi) > greatest(0.0006, 0.012 * in_hi))), false) AS mismatch,
  trim(line) = '' OR regexp_matches(replace(trim(line), ' ', ''), '^[-—–_~=.|]{{2,}}$|^[-—–_]$') AS is_none FROM (SELECT *, {_G[0]} AS lo, {_G[1]} AS hi, {_G[2]} AS in_lo, {_G[3]} AS in_hi FROM lines)"""))
def unit_check(spark, sf_dir):
    """Ranges in millimetres with inches, and whether the two agree."""
    m = X.measures(F.col("line"))
    return lines(spark, sf_dir).select(*ID, m["lo"].alias("lo"), m["hi"].alias("hi"), F.coalesce(X.units_disagree(F.col("line")), F.lit(False)).alias("mismatch"), X.is_none(F.col("line")).alias("is_none"))


@query(rules(r"""SELECT doc_id, pos, CASE WHEN regexp_matches(t, '^07[A-Z0-9]{10}$') THEN t[1:5] || '-' || t[6:] END AS tool,
  CASE WHEN w <> '' AND NOT regexp_matches(w, '^[|\[\]{}_.,''`\\/]+$') THEN w END AS word FROM (
  SELECT doc_id, pos, regexp_replace(regexp_replace(upper(line), '[^A-Z0-9]', '', 'g'), '^O7', '07') AS t, regexp_replace(line, '^[|\[\]{}_ ]+|[|\[\]{}_ ]+$', '', 'g') AS w FROM lines)"""))
def tool_numbers(spark, sf_dir):
    """Tool numbers put right; words without border glyphs."""
    return lines(spark, sf_dir).select(*ID, X.tool_number(F.col("line")).alias("tool"), X.clean_word(F.col("line")).alias("word"))


@query(rules(r"""SELECT part_number, arg_min(description, (doc_id, pos)) AS description, arg_min(doc_id, (doc_id, pos)) AS page FROM (
  SELECT doc_id, pos, regexp_replace(unnest(regexp_extract_all(line, 'Part No\.?\s*([0-9]{5}\s?[-–—]\s?[0-9]{4}|[0-9]{5}-[A-Z0-9]{3}-[A-Z0-9]{2,4})', 1)), '\s?[-–—]\s?', '-', 'g') AS part_number,
    coalesce(nullif(lower(regexp_extract(line, '(?i)(liquid gasket|sealant|thread lock|grease)', 1)), ''), '-') AS description FROM lines) GROUP BY part_number"""))
def part_numbers(spark, sf_dir):
    """Part numbers, the first mention of each."""
    line = F.col("line")
    found = lines(spark, sf_dir).select(*ID, F.explode(X.every(line, X.PART_MENTION, 1)).alias("raw"), F.coalesce(F.nullif(F.lower(F.regexp_extract(line, X.LIQUID, 1)), F.lit("")), F.lit("-")).alias("d"))
    found = found.withColumn("part_number", F.regexp_replace("raw", r"\s?[-–—]\s?", "-"))
    return found.groupBy("part_number").agg(F.min_by("d", F.struct(*ID)).alias("description"), F.min_by("doc_id", F.struct(*ID)).alias("page"))


@query(rules(r"""SELECT code, arg_min(description, (doc_id, pos)) AS description FROM (SELECT doc_id, pos, regexp_extract(line, '(?i)indicates code ([0-9]{1,2})\s*:\s*(.+)', 1) AS code, trim(regexp_extract(line, '(?i)indicates code ([0-9]{1,2})\s*:\s*(.+)', 2), ' .') AS description FROM lines) WHERE code <> '' GROUP BY code"""))
def trouble_codes(spark, sf_dir):
    """Diagnostic codes, the first of each."""
    line = F.col("line")
    rows = lines(spark, sf_dir).select(*ID, F.regexp_extract(line, X.TROUBLE, 1).alias("code"), F.regexp_replace(F.regexp_extract(line, X.TROUBLE, 2), r"^[ .]+|[ .]+$", "").alias("d"))
    return rows.where("code <> ''").groupBy("code").agg(F.min_by("d", F.struct(*ID)).alias("description"))


@query(rules(r"""SELECT doc_id, list(line ORDER BY pos)[1:12] AS consumables FROM (SELECT doc_id, line, min(pos) AS pos FROM lines WHERE length(line) < 160 AND regexp_matches(line, '(?i)\b(replace[sd]?|new (?:o-rings?|gaskets?|seals?)|liquid gasket|engine oil|grease|sealant|thread lock|coolant|atf)\b') GROUP BY ALL) GROUP BY doc_id"""))
def consumables(spark, sf_dir):
    """What a procedure uses up, each text once, the first twelve (the feature)."""
    rows = lines(spark, sf_dir).where((F.char_length("line") < 160) & F.col("line").rlike(X.CONSUMABLE)).groupBy("doc_id", "line").agg(F.min("pos").alias("pos"))
    return rows.groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), 1, 12).alias("consumables"))


@query(rules(r"""SELECT doc_id, pos, list_distinct(flatten(list_transform(regexp_extract_all(line, '\[p\.\s*([^\]]+)\]', 1), lambda x: regexp_extract_all(x, '[0-9]{1,2}-[0-9]{1,3}')))).list_sort() AS cited,
  list_distinct(flatten(list_transform(regexp_extract_all(line, 'p\.\s*((?:[0-9]{1,2}-[0-9]{1,3}(?:,\s*)?)+)', 1), lambda x: regexp_extract_all(x, '[0-9]{1,2}-[0-9]{1,3}')))).list_sort() AS labels FROM lines"""))
def page_citations(spark, sf_dir):
    """Pages cited in brackets and pages that a context names."""
    line = F.col("line")
    return lines(spark, sf_dir).select(*ID, F.array_sort(X.citations(line)).alias("cited"), F.array_sort(X.context_labels(line)).alias("labels"))


_GLOSS = values([(k, v[0], len(k)) for k, v in X.GLOSSARY.items()], "term, english, n")
_FT = _FOLD.replace("lower(line)", "lower(term)")


@query(rules(rf"""SELECT doc_id, pos, list(term ORDER BY n DESC, term) AS terms, array_to_string(list(english ORDER BY n DESC, term), ' ') AS question FROM (
  SELECT a.* FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.doc_id = a.doc_id AND b.pos = a.pos AND b.term <> a.term AND b.n >= a.n AND contains(b.ft, a.ft))) GROUP BY doc_id, pos""").replace("lines AS (", "lines AS (", 1).replace(" SELECT doc_id, pos, list(term", f", hits AS (SELECT doc_id, pos, term, english, n, ft FROM (SELECT *, {_FOLD} AS q FROM lines) JOIN (SELECT *, {_FT} AS ft FROM {_GLOSS}) ON contains(q, ft)) SELECT doc_id, pos, list(term", 1))
def glossary_hits(spark, sf_dir):
    """Glossary terms in a question, without those inside a longer hit, and the question they make."""
    # the glossary is a fixed list of literals, so its size is known
    terms = literal(spark, [(k, v[0], len(k)) for k, v in X.GLOSSARY.items()], "term string, english string, n int").withColumn("ft", X.folded(F.col("term")))
    hits = lines(spark, sf_dir).withColumn("q", X.folded(F.col("line"))).join(F.broadcast(terms), F.col("q").contains(F.col("ft"))).select(*ID, "term", "english", "n", "ft")
    rows = hits.groupBy(*ID).agg(F.collect_list(F.struct((-F.col("n")).alias("o"), "term", "english", "ft")).alias("h"))
    kept = F.array_sort(F.filter("h", lambda a: ~F.exists("h", lambda b: (b["term"] != a["term"]) & (b["o"] <= a["o"]) & F.contains(b["ft"], a["ft"]))))
    return rows.select(*ID, F.transform(kept, lambda x: x["term"]).alias("terms"), F.array_join(F.transform(kept, lambda x: x["english"]), " ").alias("question"))


@query("SELECT page_id, '[' || array_to_string(list_filter(['Section ' || (page_id % 7), nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE url END, ''), CASE WHEN page_id % 2 = 0 THEN 'D15B7/D16Z6' END, 'p. 6-' || page_id], lambda x: x IS NOT NULL), ' · ') || ']' AS prefix FROM pages")
def chunk_prefix(spark, sf_dir):
    """The context line before a chunk."""
    i = F.col("page_id")
    engines = F.when(i % 2 == 0, F.array(F.lit("D15B7"), F.lit("D16Z6"))).otherwise(F.array().cast("array<string>"))
    bits = X.prefix(F.concat(F.lit("Section "), (i % 7).cast("string")), F.when(i % 3 == 0, "").otherwise(F.col("url")), engines, F.array(F.concat(F.lit("6-"), i.cast("string"))))
    return t(spark, sf_dir, "pages").select("page_id", bits.alias("prefix"))


@query("""
WITH held AS (SELECT l_orderkey, list(DISTINCT l_quantity::INT::VARCHAR) AS nums FROM lineitem GROUP BY ALL), said AS (SELECT l_orderkey, l_linenumber, l_quantity::INT + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS nm FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN list_contains(nums, nm::VARCHAR) THEN [] ELSE [nm || ' N·m'] END AS unverified FROM said JOIN held USING (l_orderkey)""")
def answer_lines(spark, sf_dir):
    """O8, D24, E23, J6 (built-in part): lines of answers that state what their context, the quantities of their order, doesn't hold."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("nm"))
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "nm"))), lambda x: F.concat(F.lit("bolt "), x["nm"].cast("string"), F.lit(" N·m"))), "\n")
    held = rows.groupBy("l_orderkey").agg(X.plain(context).alias("ctx")).withColumn("nums", X.numbers(F.col("ctx")))
    line = F.concat(F.lit("Tighten to "), (F.col("nm") + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit(" N·m."))
    return rows.join(held, "l_orderkey").select("l_orderkey", "l_linenumber", X.unverified(line, F.col("ctx"), F.col("nums"), []).alias("unverified"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN (props->>'k')::INT END AS k FROM events")
def answer_json(spark, sf_dir):
    """The JSON of answers: bare, fenced, inside other words, broken."""
    raw = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Here: "), "props", F.lit(" ok")))
    return t(spark, sf_dir, "events").select("event_id", F.from_json(X.extracted_json(F.coalesce(raw, F.concat(F.lit("{"), "props"))), "k int")["k"].alias("k"))


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system' OR turn = 0), '') AS system_text, count(*) FILTER (WHERE NOT (role = 'system' OR turn = 0)) AS n_rest FROM conversations GROUP BY conv_id")
def split_system(spark, sf_dir):
    """The system text apart from the other messages."""
    is_system = (F.col("role") == "system") | (F.col("turn") == 0)
    pieces = F.array_sort(F.collect_list(F.when(is_system, F.struct("turn", "text"))))
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "\n").alias("system_text"), F.count_if(~is_system).alias("n_rest"))


@query("SELECT p_partkey, list_concat(range(p_size::BIGINT, p_size + 4), [p_partkey]) AS pages FROM part")
def page_specs(spark, sf_dir):
    """Page lists."""
    size = F.col("p_size")
    spec = F.concat_ws("", size.cast("string"), F.lit("-"), (size + 3).cast("string"), F.lit(", "), F.col("p_partkey").cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", F.transform(X.page_list(spec), lambda x: x.cast("long")).alias("pages"))


@query(rules(r"""SELECT doc_id, pos FROM lines WHERE list_filter(['P/S pump', 'hot bolts', 'the seal'], lambda p: len(list_filter(regexp_extract_all(lower(p), '[a-z0-9/]+'), lambda w: length(w) >= 3 OR contains(w, '/'))) > 0
  AND len(list_filter(list_filter(regexp_extract_all(lower(p), '[a-z0-9/]+'), lambda w: length(w) >= 3 OR contains(w, '/')), lambda w: NOT contains(lower(line), w))) = 0) <> []"""))
def matching_steps(spark, sf_dir):
    """Steps that hold all words of one of the phrases."""
    tokens = F.transform(F.array(*map(F.lit, ["P/S pump", "hot bolts", "the seal"])), X.phrase_tokens)
    low = F.lower("line")
    return lines(spark, sf_dir).where(F.exists(tokens, lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: F.contains(low, w)))).select(*ID)
