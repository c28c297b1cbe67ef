"""Secret scan: base patterns, and a randomness test battery with false-discovery control, on DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three patterns. The method looks at every further run
of 20 or more key characters that holds a letter and a digit, infers its encoding (hexadecimal, base32, base62,
base64 or URL-safe base64) and tests the hypothesis that its characters are independent and uniform:

* chi-squared of the character counts against the uniform alphabet (upper tail);
* Wald-Wolfowitz runs above and below the middle of the alphabet (two-sided);
* lag-one serial correlation of the character values (two-sided).

The three p-values go into Fisher's statistic. Written text is far from uniform and rejects; key material does
not. How often pure chance rejects is controlled by the Benjamini-Hochberg rule, apart for each encoding and
length band (short runs test weakly, and would else hide behind long ones). The rule needs only counts of
p-values in fixed bins, a table of at most bands x encodings x BINS rows, so it covers the whole corpus without
sorting it. Runs that are not rejected are reported as spans of kind `random`.

A run that mixes the marks of base64 (+ /) with those of its URL-safe form (- _) is in neither alphabet, as a key
behind a path is. All its pieces of 20 or more characters in either alphabet are tested instead; of spans that lie
in one another the longest is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, staged, whole

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the matches of AKIA[A-Z0-9]+ with 18 or more characters
HEX = r"[0-9a-f]{16,}"  # the matches of [0-9a-f]+ with 16 or more characters
RUN = r"[A-Za-z0-9+/_-]{20,}"
#: What a run is cut into where it mixes both alphabets.
PIECES = (r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9+/]{20,}")
KINDS = ("assign", "access", "hex", "random")

BANDS = (28, 40, 64, 128)
LEVEL = 0.05
#: Width of a bin of -ln p, and the last bin.
BIN, BINS = 0.05, 600

_ALPHABETS = """CASE encoding WHEN 'hex' THEN '0123456789abcdef' WHEN 'base32' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
 WHEN 'base62' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'
 WHEN 'base64' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/'
 WHEN 'url64' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_' ELSE '' END"""

_MATCH = "struct<start:bigint,end:bigint,word:string>"
_NO_MATCHES = f"CAST(array() AS array<{_MATCH}>)"


#: Elements of a stretch over which running values are made one by one, and levels of stretches of stretches (each makes expressions longer,
#: which the driver has to plan). Runs times spans up to which each run is compared with each span.
STRETCH, LEVELS, FEW = 512, 1, 4096
#: Characters of the pieces in which a text is masked.
PIECE = 512


def _let(name: str, value: str, body: str) -> str:
    """SQL of body, in which `name` stands for the value, made once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, join: str, level: int = LEVELS) -> str:
    """SQL of the array of running values of an array of non-negative longs under `join`, an expression of {a} and {b}.

    Arrays grow by copying, so an array of n is made from stretches of STRETCH, whose own last values run in the same way:
    n * STRETCH / 2 copies in place of n * n / 2.
    """
    w, p, e = f"w{level}", f"p{level}", f"e{level}"
    each = join.format(a="acc.at", b="x")
    plain = f"(acc, x) -> named_struct('at', {each}, 'out', concat(acc.out, array({each}))), acc -> acc.out)"
    plain = "aggregate({0}, named_struct('at', 0L, 'out', CAST(array() AS array<bigint>)), " + plain
    if not level:
        return plain.format(values)
    cut = plain.format(f"slice({w}, CAST(b * {STRETCH} + 1 AS INT), {STRETCH})")
    parts = f"transform(sequence(0L, CAST((size({w}) - 1) div {STRETCH} AS BIGINT)), b -> {cut})"
    ends = _running(f"transform({p}, q -> element_at(q, -1))", join, level - 1)
    moved = f"flatten(zip_with({p}, concat(array(0L), slice({e}, 1, size({e}) - 1)), (q, s) -> transform(q, x -> {join.format(a='s', b='x')})))"
    return _let(w, values, f"CASE WHEN size({w}) <= {STRETCH} THEN {plain.format(w)} ELSE {_let(p, parts, _let(e, ends, moved))} END")


def _matches(pattern: str, word_group: int = 0, text: str = "text") -> str:
    """SQL of the array of matches in the expression `text`: code point start and end, and a group's text.

    The pieces between matches (split) and the matches (regexp_extract_all) come from the same search, so
    their lengths add up to positions.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found, pieces = f"regexp_extract_all({text}, '{p}', 0)", f"split({text}, '{p}', -1)"
    words = f"regexp_extract_all({text}, '{p}', {word_group})" if word_group else "f"
    sizes = f"zip_with(f, slice({pieces}, 1, size(f)), (m, g) -> CAST(length(m) + length(g) AS BIGINT))"
    spans = f"zip_with(f, {_running(sizes, '{a} + {b}')}, (m, at) -> named_struct('start', at - length(m), 'end', at))"
    out = f"zip_with({spans}, {words}, (s, w) -> named_struct('start', s.start, 'end', s.end, 'word', w))"
    return f"CASE WHEN {text} RLIKE '{p}' THEN {_let('f', found, out)} ELSE {_NO_MATCHES} END"


def _not_inside(runs: str, spans: str) -> str:
    """SQL of those of `runs` that lie in none of `spans`; both are arrays of structs with start and end."""
    few = "filter(l, m -> NOT exists(h, b -> b.start <= m.start AND m.end <= b.end))"
    # in the order of their starts, spans first, a run lies in a span if the furthest end before it reaches its own
    events = "sort_array(concat(transform(h, b -> named_struct('start', b.start, 'run', -1, 'end', b.end)), transform(l, (m, i) -> named_struct('start', m.start, 'run', i, 'end', m.end))))"
    reached = _running("transform(v, x -> CASE WHEN x.run < 0 THEN x.end ELSE 0L END)", "greatest({a}, {b})")
    free = f"filter(zip_with(v, {reached}, (x, far) -> CASE WHEN x.run >= 0 AND far < x.end THEN x.run END), i -> i IS NOT NULL)"
    many = _let("v", events, f"transform({free}, i -> element_at(l, i + 1))")
    return _let("l", runs, _let("h", spans, f"CASE WHEN size(l) * CAST(size(h) AS BIGINT) <= {FEW} THEN {few} ELSE {many} END"))


def _in_one_alphabet(runs: str) -> str:
    """SQL of the array `runs` of matches, those that mix both alphabets replaced by their pieces."""
    pieces = ", ".join(f"transform({_matches(p, 0, 'q.word')}, x -> named_struct('start', q.start + x.start, 'end', q.start + x.end, 'word', x.word))" for p in PIECES)
    return f"flatten(transform({runs}, q -> CASE WHEN q.word RLIKE '[+/]' AND q.word RLIKE '[_-]' THEN array_distinct(concat({pieces})) ELSE array(q) END))"


# The rational approximation of the normal tail, Abramowitz and Stegun 26.2.17.
_TAIL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _upper_tail(z: str) -> str:
    """SQL of P(N(0,1) > z)."""
    r, *b = _TAIL
    t = f"(1D / (1D + {r}D * abs({z})))"
    poly = "0D"
    for c in reversed(b):
        poly = f"(({poly} + {c}D) * {t})"
    q = f"(exp(-0.5D * ({z}) * ({z})) / sqrt(2D * pi()) * {poly})"
    return f"CASE WHEN {z} >= 0 THEN {q} ELSE 1D - {q} END"


def _tested(run: str) -> str:
    """SQL of the array `run` of matches with encoding, length band and the bin of the combined p-value."""
    steps = [
        # what it is
        r"""named_struct('start', m.start, 'end', m.end, 'word', m.word, 'encoding',
            CASE WHEN NOT (m.word RLIKE '[0-9]' AND m.word RLIKE '[A-Za-z]') THEN 'none'
                 WHEN m.word RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex' WHEN m.word RLIKE '^[A-Z2-7]+$' THEN 'base32'
                 WHEN m.word RLIKE '^[A-Za-z0-9]+$' THEN 'base62' WHEN m.word RLIKE '^[A-Za-z0-9+/]+$' THEN 'base64'
                 WHEN m.word RLIKE '^[A-Za-z0-9_-]+$' THEN 'url64' ELSE 'none' END)""",
        # its values
        f"""named_struct('start', m.start, 'end', m.end, 'encoding', m.encoding, 'n', CAST(length(m.word) AS DOUBLE),
            'band', aggregate(array({", ".join(map(str, BANDS))}), 0, (a, b) -> a + CASE WHEN length(m.word) >= b THEN 1 ELSE 0 END),
            'word', CASE WHEN m.encoding = 'hex' THEN lower(m.word) ELSE m.word END,
            'alphabet', {_ALPHABETS.replace('CASE encoding', 'CASE m.encoding')})""",
        """named_struct('start', m.start, 'end', m.end, 'encoding', m.encoding, 'n', m.n, 'band', m.band, 'k', CAST(length(m.alphabet) AS DOUBLE),
            'v', transform(split(m.word, ''), c -> CAST(instr(m.alphabet, c) - 1 AS DOUBLE)),
            'squares', aggregate(split(m.alphabet, ''), 0D, (a, c) -> a + pow(m.n - length(replace(m.word, c, '')), 2)))""",
        # its moments
        """named_struct('start', m.start, 'end', m.end, 'encoding', m.encoding, 'n', m.n, 'band', m.band, 'df', m.k - 1,
            'chi', m.k / m.n * m.squares - m.n, 'mean', aggregate(m.v, 0D, (a, x) -> a + x) / m.n, 'v', m.v,
            'high', aggregate(m.v, 0D, (a, x) -> a + CASE WHEN x >= m.k / 2 THEN 1D ELSE 0D END),
            'runs', aggregate(zip_with(slice(m.v, 1, size(m.v) - 1), slice(m.v, 2, size(m.v) - 1), (x, y) -> CASE WHEN (x >= m.k / 2) <> (y >= m.k / 2) THEN 1D ELSE 0D END), 1D, (a, x) -> a + x))""",
        # the three scores
        """named_struct('start', m.start, 'end', m.end, 'encoding', m.encoding, 'band', m.band,
            'z1', (pow(greatest(m.chi, 0D) / m.df, 1D / 3) - (1D - 2D / (9D * m.df))) / sqrt(2D / (9D * m.df)),
            'z2', CASE WHEN m.high = 0 OR m.high = m.n THEN 9D ELSE
                abs(m.runs - 1D - 2D * m.high * (m.n - m.high) / m.n) / sqrt(greatest(1e-9D, 2D * m.high * (m.n - m.high) * (2D * m.high * (m.n - m.high) - m.n) / (m.n * m.n * (m.n - 1D)))) END,
            'z3', sqrt(m.n) * abs(aggregate(zip_with(slice(m.v, 1, size(m.v) - 1), slice(m.v, 2, size(m.v) - 1), (x, y) -> (x - m.mean) * (y - m.mean)), 0D, (a, x) -> a + x))
                / greatest(1e-9D, aggregate(m.v, 0D, (a, x) -> a + (x - m.mean) * (x - m.mean))))""",
        # Fisher's statistic has six degrees of freedom, half of it is h
        f"""named_struct('start', m.start, 'end', m.end, 'encoding', m.encoding, 'band', m.band, 'h',
            -ln(greatest(1e-100D, {_upper_tail("least(m.z1, 20D)")})) - ln(greatest(1e-100D, 2D * {_upper_tail("least(m.z2, 20D)")})) - ln(greatest(1e-100D, 2D * {_upper_tail("least(m.z3, 20D)")})))""",
        f"""named_struct('start', m.start, 'end', m.end, 'stratum', concat(m.encoding, ':', m.band),
            'bin', CAST(least({BINS}D, floor(greatest(0D, m.h - ln(1D + m.h + m.h * m.h / 2D)) / {BIN}D)) AS INT))""",
    ]
    out = f"filter(transform({run}, m -> {steps[0]}), m -> m.encoding <> 'none')"
    for step in steps[1:]:
        out = f"transform({out}, m -> {step})"
    return out


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """One row for each row of docs with the columns `keep`, and

    base: array of (start, kind, end), kind 0 to 2 of KINDS, by start and kind;
    random: array of (start, kind, end, stratum, bin) of the tested runs that lie in no base span.
    """
    prepared(docs.sparkSession)
    rows = docs.select(*keep, whole().alias("text"))
    rows = rows.withColumns({"assign": F.expr(_matches(ASSIGN, 2)), "access": F.expr(_matches(ACCESS)), "hex": F.expr(_matches(HEX)), "run": F.expr(_matches(RUN))})
    spans = [
        f"transform({'filter(assign, m -> length(m.word) >= 12)' if kind == 'assign' else kind}, m -> named_struct('start', m.start, 'kind', {k}, 'end', m.end))"
        for k, kind in enumerate(KINDS[:3])
    ]
    rows = rows.withColumn("base", F.expr(f"sort_array(concat({', '.join(spans)}))"))
    return rows.select(*keep, "base", F.expr(_tested(_not_inside(_in_one_alphabet("run"), "base"))).alias("random"))


def cuts(found: DataFrame, level: float = LEVEL) -> dict[str, int]:
    """By stratum, the first bin of p-values that the Benjamini-Hochberg rule rejects as not random.

    A bin counts with its largest p-value, so the rule errs on the side of keeping a run.
    """
    bins = found.select(F.explode("random").alias("r")).groupBy("r.stratum", "r.bin").count()
    above = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    ranked = bins.withColumns({"at_most": F.sum("count").over(above), "tests": F.sum("count").over(Window.partitionBy("stratum"))})
    ok = ranked.where(F.exp(-F.col("bin") * BIN) <= level * F.col("at_most") / F.col("tests"))
    return {r["stratum"]: r["cut"] for r in ok.groupBy("stratum").agg(F.min("bin").alias("cut")).collect()}


def kept(cut: dict[str, int]) -> Column:
    """base and the random runs that stand and lie in no longer one, as one array of (start, kind, end) by start and kind."""
    tests = "".join(f" WHEN '{s}' THEN {c}" for s, c in sorted(cut.items()))
    below = f"r.bin < CASE r.stratum{tests} ELSE {BINS + 1} END" if cut else "true"
    # runs are different spans: in the order of their starts, longer ones first, one lies in another if the furthest end before it reaches its own
    ordered = f"sort_array(transform(filter(random, r -> {below}), r -> named_struct('start', r.start, 'from_end', -r.end)))"
    before = _running("transform(l, x -> -x.from_end)", "greatest({a}, {b})")
    outer = f"filter(zip_with(l, concat(array(0L), slice({before}, 1, greatest(size(l) - 1, 0))), (x, far) -> CASE WHEN far < -x.from_end THEN x END), x -> x IS NOT NULL)"
    stand = f"CASE WHEN size(random) = 0 THEN CAST(array() AS array<struct<start:bigint,from_end:bigint>>) ELSE {_let('l', ordered, outer)} END"
    return F.expr(f"sort_array(concat(base, transform({stand}, r -> named_struct('start', r.start, 'kind', 3, 'end', -r.from_end))))")


def _listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def scan(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random), one row for each row of docs.

    A null or empty text has no spans: counts 0, spans '' and the SHA-256 of ''. Repeated rows are scanned one
    by one (and count as tests each), an empty table gives an empty result, other columns are not read.
    """
    found = staged(find(docs, "doc_id"), "secrets")
    rows = found.withColumn("spans", kept(cuts(found, level)))
    n = {f"n_{kind}": F.expr(f"CAST(size(filter(spans, s -> s.kind = {k})) AS BIGINT)") for k, kind in enumerate(KINDS)}
    return rows.select(
        "doc_id", *[n[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:3]], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), n["n_random"].alias("n_random")
    )


def _masked(text: str, spans: str, mask: str) -> str:
    """SQL of the text with the mask in place of each of `spans`, in order, overlapping ones as one.

    A string of marks is made that says of every character whether it stays (0), is the first of a span (1) or another of it (2);
    text and marks are then put together in stretches, as a place in a text is only found by counting from its start.
    """
    far = _running("transform(l, x -> x.end)", "greatest({a}, {b})")
    # (start, end) from where the spans before it end; what starts inside these goes on with them
    own = "zip_with(l, concat(array(0L), slice(e, 1, size(e) - 1)), (x, far) -> named_struct('gap', greatest(x.start - far, 0L), 'first', x.start >= far, 'n', greatest(x.end - greatest(x.start, far), 0L)))"
    marks = "concat(array_join(transform(o, x -> concat(repeat('0', CAST(x.gap AS INT)), CASE WHEN x.first THEN concat('1', repeat('2', CAST(x.n - 1 AS INT))) ELSE repeat('2', CAST(x.n AS INT)) END)), ''), repeat('0', CAST(length({0}) - element_at(e, -1) AS INT)))"
    pieces = f"regexp_extract_all({{0}}, '(?s).{{{{1,{PIECE}}}}}', 0)"
    both = "zip_with(split(t, ''), split(k, ''), (c, m) -> CASE m WHEN '0' THEN c WHEN '1' THEN '{0}' ELSE '' END)".format(mask.replace("\\", "\\\\").replace("'", "\\'"))
    out = f"array_join(zip_with({pieces.format(text)}, {pieces.format(marks.format(text))}, (t, k) -> CASE WHEN contains(k, '1') OR contains(k, '2') THEN array_join({both}, '') ELSE t END), '')"
    return _let("l", spans, _let("e", far, _let("o", own, out)))


def redact(docs: DataFrame, level: float = LEVEL, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mask, overlapping spans by one, and n_chars following the text.

    Documents without spans stay as they are, a null text stays null.
    """
    clash = {c.lower() for c in docs.columns} & {"base", "random", "spans", "done"}
    names = {c: f"_kept{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text")) if clash else docs
    keep = list(names.values()) if clash else [c for c in docs.columns if c != "text"]
    found = staged(find(plain.withColumn("_text", F.col("text")), *keep, "_text"), "redact")
    rows = found.withColumn("spans", kept(cuts(found, level)))
    rows = rows.withColumn("done", F.expr(f"CASE WHEN size(spans) = 0 THEN _text ELSE {_masked('_text', 'spans', mask)} END"))
    out = []
    for c, t in docs.dtypes:
        if c == "text":
            out.append(F.col("done").alias(c))
        elif c == "n_chars":
            source = names[c] if clash else c
            out.append(F.when(F.size("spans") > 0, F.length("done")).otherwise(F.col(source)).cast(t).alias(c))
        else:
            out.append(F.col(names[c]).alias(c) if clash else F.col(c))
    return rows.select(*out)
