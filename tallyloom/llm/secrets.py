"""Secret scans in SQL expressions: three fixed forms, and character Markov models for the rest.

Spans of a form are found without a parser: the text is split at the matches, and the lengths of the gaps
and of the matches add up to positions, in code points and in bytes. Tokens of 16 characters or more are then
weighed by two first-order Markov models, of random strings and of ordinary identifiers: the sum of the
logarithms of their ratios, character by character, has to pass THRESHOLD.

The models are trained from labelled samples by counting pairs of characters. The default samples are made
by a rule: digests in several alphabets, and joined words in the styles of identifiers, with numbers; to these
ordinary_words() adds words of a corpus, of a bounded number of its texts.

Defined results: a null text is an empty one. Other columns are ignored. Spans may overlap; redact() joins
those that do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base forms, in the order in which spans that begin together are listed, and the least length of a match (of its value for assign).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the models weigh: shorter ones hold too few pairs of characters for odds like THRESHOLD.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: Natural logarithm of the odds that the evidence must pass: a thousand to one.
THRESHOLD = math.log(1000)
SYMBOLS = 67
MARK = "[secret]"

# Words of which ordinary identifiers are joined.
WORDS = "account action array audio backup block buffer build cache chapter client column config context counter count data date default device document draft email encode entry error event export field figure file filter folder frame group handler header height image import index input invoice item journal label layer length level line list load local master message method model module month name node number object offset order output page parent part path payload photo plugin pointer policy position prefix project proxy query queue record region release render report request result retry review route row sample schema scope score screen search section segment server session setting shape signal size source spec stage start state status step stream string style submit suffix table target task template test thread ticket time title total track type unit update upload user value vector version video view volume week width window worker year".split()


def default_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """(text, random): n strings of each label."""
    words = F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda salt: F.get(words, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(WORDS))).cast("int"))
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    number = F.pmod(F.xxhash64("id", F.lit("number")), F.lit(3000)).cast("string")
    a, b, c = pick("a"), pick("b"), pick("c")
    ordinary = F.array(F.concat_ws("_", a, b, c, number), F.concat(a, F.initcap(b), F.initcap(c), number), F.concat_ws("-", a, b, c, number), F.concat_ws("/", a, b, c, number), F.upper(F.concat_ws("_", a, b, c, number)), F.concat(F.initcap(a), F.initcap(b), number, F.initcap(c)))
    b64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    chance = F.array(digest, F.md5(digest.cast("binary")), b64, F.translate(b64, "+/", "-_"), F.concat(F.conv(F.substring(digest, 1, 15), 16, 36), F.conv(F.substring(digest, 20, 15), 16, 36)), F.translate(b64, "+/", ""))
    of = lambda styles, k: F.get(styles, F.pmod(F.col("id"), F.lit(k)).cast("int"))
    ids = spark.range(n)
    return ids.select(of(ordinary, 6).alias("text"), F.lit(False).alias("random")).unionAll(ids.select(of(chance, 6).alias("text"), F.lit(True).alias("random")))


def ordinary_words(docs: DataFrame, texts: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, random): words of ASCII letters, six or more, of the texts whose ids have the least hashes; all count as ordinary."""
    first = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(texts)
    some = docs.join(F.broadcast(first), docs[id_col] == first["id"], "left_semi")  # `texts` ids at most
    words = some.select(F.explode(F.expr(f"regexp_extract_all(coalesce(cast(`{text_col}` as string), ''), r'(?<![A-Za-z])[A-Za-z]{{6,}}(?![A-Za-z])', 0)")).alias("text"))
    return words.distinct().select("text", F.lit(False).alias("random"))


def _code(text: Column, at: Column) -> Column:
    return F.ascii(F.substring(text, at, F.lit(1)))


def _pairs(text: Column) -> Column:
    """128 * code + code of each two neighbouring characters of an ASCII text of two characters or more."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: _code(text, i) * 128 + _code(text, i + 1))


def train(samples: DataFrame, text_col: str = "text", label_col: str = "random") -> list[float]:
    """For each pair of ASCII characters the log of how likelier the second is after the first in random strings. At most 2 * 128 * 128 counts reach the driver."""
    rows = samples.select(F.col(text_col).alias("text"), F.col(label_col).alias("random")).where(F.col("random").isNotNull() & F.col("text").rlike(r"\A[\x00-\x7f]{2,}\z"))
    counts = {(r.random, r.pair): r.n for r in rows.select("random", F.explode(_pairs(F.col("text"))).alias("pair")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    after: dict[tuple[bool, int], int] = {}
    for (label, pair), n in counts.items():
        after[label, pair >> 7] = after.get((label, pair >> 7), 0) + n
    chance = lambda label, pair: math.log((counts.get((label, pair), 0) + 0.5) / (after.get((label, pair >> 7), 0) + 0.5 * SYMBOLS))
    return [chance(True, p) - chance(False, p) for p in range(128 * 128)]


#: Matches that are added up in one go: an array of results is copied once for each, so long arrays are built of shorter ones.
BLOCK = 256
NONE = "cast(array() as array<struct<s:int,k:int,e:int,bs:int,be:int>>)"


def _let(name: str, value: str, body: str) -> str:
    """body with name for value, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _scan(items: str, start: str, step: str, out: str, kind: str, join: str) -> str:
    """The array of `out` for each x of items, where a is what `step` has made of `start` and all items before, in time linear but for BLOCK.

    join: what `step` makes of a over a whole block whose own result is t. kind: the type of out's elements.
    """
    empty = f"cast(array() as array<{kind}>)"
    fold = f"aggregate(block, {start}, (a, x) -> {step})"
    begins = f"aggregate(blocks, named_struct('a', {start}, 'out', cast(array() as array<{START_TYPE}>)), (b, block) -> named_struct('a', {_let('t', fold, _let('a', 'b.a', join))}, 'out', concat(b.out, array(b.a))), b -> b.out)"
    each = f"aggregate(block, named_struct('a', first, 'out', {empty}), (b, x) -> {_let('a', 'b.a', f'named_struct({chr(39)}a{chr(39)}, {step}, {chr(39)}out{chr(39)}, concat(b.out, array({out})))')}, b -> b.out)"
    blocks = f"transform(if(size(items) = 0, cast(array() as array<int>), sequence(0, (size(items) - 1) div {BLOCK})), i -> slice(items, i * {BLOCK} + 1, {BLOCK}))"
    return _let("items", items, _let("blocks", blocks, f"flatten(zip_with(blocks, {begins}, (block, first) -> {each}))"))


START_TYPE = "struct<c:int,b:int>"


def _spans(text: Column, pattern: str, kind: int, keep: str = "true", group: int = 0) -> Column:
    """The spans (s, k, e) of the matches of pattern, with their places in bytes (bs, be); keep: a condition on x.val, the group's text."""
    quoted = "r'" + pattern.replace("'", "\\x27") + "'"
    hits = f"regexp_extract_all(_text, {quoted}, 0)"
    vals = f"regexp_extract_all(_text, {quoted}, {group})" if group else hits
    items = (
        f"zip_with(slice(split(_text, {quoted}, -1), 1, size(hits)), zip_with(hits, {vals if group else 'hits'}, (h, val) -> named_struct('h', h, 'x', named_struct('val', val))), "
        f"(g, m) -> named_struct('g', length(g), 'gb', octet_length(g), 'h', length(m.h), 'hb', octet_length(m.h), 'ok', {_let('x', 'm.x', keep)}))"
    )
    found = _scan(
        "items_of",
        "named_struct('c', 0, 'b', 0)",
        "named_struct('c', a.c + x.g + x.h, 'b', a.b + x.gb + x.hb)",
        f"if(x.ok, named_struct('s', a.c + x.g, 'k', {kind}, 'e', a.c + x.g + x.h, 'bs', a.b + x.gb, 'be', a.b + x.gb + x.hb), cast(null as struct<s:int,k:int,e:int,bs:int,be:int>))",
        "struct<s:int,k:int,e:int,bs:int,be:int>",
        "named_struct('c', a.c + t.c, 'b', a.b + t.b)",
    )
    expr = _let("hits", hits, _let("items_of", items, f"filter({found}, x -> x is not null)"))
    return F.when(F.col("_text").rlike(pattern), F.expr(expr)).otherwise(F.expr(NONE))


def spans(df: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """(row, _text, _base, _spans): df's columns as a struct, the text (never null), the base spans and all spans, in order of start and kind."""
    table = f"cast(split('{','.join(f'{x:.4f}' for x in model)}', ',') as array<double>)"
    odds = f"aggregate(sequence(1, length(x.val) - 1), 0D, (sum, i) -> sum + get({table}, ascii(substring(x.val, i, 1)) * 128 + ascii(substring(x.val, i + 1, 1)))) >= {THRESHOLD!r}D"
    text = F.col("_text")
    return (
        df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
        .withColumn("_base", F.array_sort(F.concat(_spans(text, ASSIGN, 0, f"length(x.val) >= {ASSIGN_LEAST}", 1), _spans(text, ACCESS, 1), _spans(text, HEX, 2))))
        .withColumn("_spans", F.array_sort(F.concat("_base", _spans(text, TOKEN, 3, odds))))
    )


def _joined(column: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({column}, x -> concat(get({names}, x.k), ':', x.s, ':', x.e)), ',')")


def report(df: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of each whole text."""
    found = spans(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    count = lambda k, column="_base": F.expr(f"cast(size(filter({column}, x -> x.k = {k})) as bigint)")
    return found.select("row.doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_joined("_base").cast("binary"), 256).alias("base_sha256"), _joined("_spans").alias("spans"), count(3, "_spans").alias("n_markov"))


def redact(df: DataFrame, model: list[float], text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """df with each run of overlapping spans in its text replaced by MARK, and with chars_col set to the new length; null texts stay null.

    Texts are cut by bytes, which takes no search, and joined once.
    """
    # Of each span the end of all before it, and of all together; a span that begins no earlier ends a piece that stays.
    pieces = _scan(
        "_spans",
        "named_struct('c', 0, 'b', 0)",
        "named_struct('c', greatest(a.c, x.e), 'b', greatest(a.b, x.be))",
        "if(x.s >= a.c, named_struct('from', a.b, 'to', x.bs), cast(null as struct<from:int,to:int>))",
        "struct<from:int,to:int>",
        "named_struct('c', greatest(a.c, t.c), 'b', greatest(a.b, t.b))",
    )
    rest = "named_struct('from', array_max(transform(_spans, x -> x.be)), 'to', octet_length(_text))"
    cut = F.expr(_let("bytes", "cast(_text as binary)", f"array_join(transform(concat(filter({pieces}, p -> p is not null), array({rest})), p -> cast(substring(bytes, p.from + 1, p.to - p.from) as string)), '{MARK}')"))
    found = spans(df, model, text_col)
    hit = F.size("_spans") > 0
    new = {text_col: F.when(hit, cut).otherwise(F.col("row")[text_col])}
    if chars_col:
        new[chars_col] = F.when(hit, F.length(cut).cast(df.schema[chars_col].dataType)).otherwise(F.col("row")[chars_col])
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in df.columns))
