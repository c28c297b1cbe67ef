"""Text expressions: normal forms, tokens, overlaps and the patterns of the answer judge. All but two are plain columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

# ASCII punctuation and the articles that answers are compared without.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")

# Words that carry no content, of the answer judge.
JUDGE_STOPWORDS = (
    "a an the of in on at to for by with and or is are was were be been has have had it its this that these those there their they he she his her as from"
).split()

# Decision stances and abstentions, as patterns over judge-normalised text.
_DECISION = r"(a |any |his |her |their |the |a final |a firm )?(final |definitive |firm )?decision"
_NOT_A_COMMITMENT = r"(not|decide|announce|make|confirm|wait|see|consider|think|be deciding)\b"
STANCES = {
    "undecided": (
        r"\byet to (make|take|reach|announce|confirm|decide)\b",
        r"\bundecided\b",
        r"\bnot (yet )?decided\b",
        rf"\bnot (yet )?(made|reached|taken) {_DECISION}\b",
        r"\bno (final |definitive |firm )?decision\b",
        r"\bstill deciding\b",
    ),
    "affirmative": (
        r"^yes\b",
        r"\b(has|have|had|is|are) decided (to|that)\b",
        rf"(?<!whether )(?<!if )\b[a-z]+ will (?!{_NOT_A_COMMITMENT})[a-z]+",
        rf"^will (?!{_NOT_A_COMMITMENT})[a-z]+",
    ),
    "negative": (
        r"^no\b(?! (final |definitive |firm )?decision)",
        rf"\bwill not (?!{_NOT_A_COMMITMENT})[a-z]+",
        r"\b(has|have|had|is|are) decided not to\b",
        r"\b(is|are|was|were) not (going|planning) to\b",
    ),
}
ABSTENTIONS = (
    r"^unknown$",
    r"\bunknown\b",
    r"\bno idea\b",
    r"\bi do not know\b",
    r"\b(does|do|did) not (provide|mention|say|state|specify|contain|include|indicate)\b",
    r"\bnot (mentioned|provided|specified|stated|given) in the (context|passages?|text)\b",
    r"\bcan not (be )?(determine|determined|answer|tell|say)\b",
    r"\b(not enough|insufficient|no) information\b",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_split(c: Column | str) -> Column:
    """Tokens between ASCII blanks, none of them empty; of a null text, none."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")


def space_split(c: Column | str) -> Column:
    """Tokens between single spaces, empty ones kept, as rankers count them."""
    return F.split(F.coalesce(_col(c), F.lit("")), " ", -1)


def answer_tokens(c: Column | str) -> Column:
    """Lowered, ASCII punctuation deleted, articles left out."""
    bare = F.translate(F.lower(F.coalesce(_col(c), F.lit(""))), PUNCTUATION, "")
    return F.filter(blank_split(bare), lambda x: ~x.isin(*ARTICLES))


def normalize_answer(c: Column | str) -> Column:
    return F.array_join(answer_tokens(c), " ")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Compatibility form, case folded, blanks collapsed: the key under which questions count as equal."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


# The steps of the answer judge's normal form, after compatibility form and lowering.
NORMAL_STEPS = (
    ("[‘’]", "'"),
    (r"\bwon't\b", "will not"),
    (r"\bcan't\b", "can not"),
    (r"\bcannot\b", "can not"),
    (r"n't\b", " not"),
    (r"(\d),(\d{3})\b", "$1$2"),
    (r"[^a-z0-9.\s]", " "),
    (r"(?<!\d)\.|\.(?!\d)", " "),
    (r"\s+", " "),
)


def judge_normalize(c: Column | str, compatible: bool = False) -> Column:
    """Compatibility form, lowered, as [a-z0-9.] words: contractions written out, 1,000 as 1000, dots only between digits.

    compatible: the text is in Unicode compatibility form already (see nfkc), so no Python is needed.
    """
    t = F.coalesce(_col(c), F.lit(""))
    t = F.lower(t if compatible else nfkc(t))
    for pattern, by in NORMAL_STEPS:
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t)


def normal_form(s: str) -> str:
    """judge_normalize() of a Python string."""
    s = unicodedata.normalize("NFKC", s).lower()
    for pattern, by in NORMAL_STEPS:
        s = re.sub(pattern, by.replace("$", "\\"), s)
    return s.strip()


# --- notation that whole-expression matching cannot read ---------------------------------------------------

# Patterns of such notation, and characters that quote.
UNSAFE_NOTATION = (
    r"[*/\\^%=<>]|\d\s*[:!]|\d\s*[xX_]\s*\d|\+(?![0-9])",
    r"\d\s*[eE]\s*[+-]?\s*\d|\d\s*[-+\u2010-\u2015]\s*\d|\d\s+(?i:to)\s+[+-]?\d",
    r"[\u2212\u2070-\u209f]|\d[,'\u2019]\d|(?<!\d)\.\d|\d\.\.\d|\d\.\d+\.\d",
    r"[+-]\s+[0-9]|[+-]{2,}\d|\d[+-]",
)
QUOTES = "\"'`\u201a\u201e\u2032\u2033\u300c\u300d\u300e\u300f\u301d\u301e\u301f"

_UNSAFE = re.compile("|".join(f"(?:{p})" for p in UNSAFE_NOTATION))
_DIGITS = frozenset("0123456789")


def _unsafe(s: str) -> bool:
    kinds = [(c, unicodedata.category(c)) for c in set(s)]
    numeric = {c for c in set(s) if c.isnumeric()}
    if numeric - _DIGITS or any(c != "+" and k[0] in "MS" or k == "Cf" for c, k in kinds):
        return True
    if numeric and any(k == "Pd" and c != "-" or k[0] == "L" and not c.isascii() for c, k in kinds):
        return True
    return _UNSAFE.search(s) is not None


def is_unsafe(s: str) -> bool:
    """Whether a text, as it is or in compatibility form, holds notation that plain number matching would misread."""
    return _unsafe(s) or _unsafe(unicodedata.normalize("NFKC", s))


def is_quoting(s: str) -> bool:
    """Whether a quotation mark stands anywhere in the compatibility form but as an apostrophe within a word."""
    s = re.sub(r"(?<=\w)['\u2019](?=\w)", "", unicodedata.normalize("NFKC", s))
    return any(c in QUOTES or unicodedata.category(c) in ("Pi", "Pf") or "QUOTATION MARK" in unicodedata.name(c, "") for c in set(s))


def expression(s: str) -> str | None:
    """The form in which whole expressions are compared: numbers as they are, the rest in normal form; None if unsafe or quoting."""
    if is_unsafe(s) or is_quoting(s):
        return None
    s, out, at = unicodedata.normalize("NFKC", s), [], 0
    for m in re.finditer(r"[+-]?\d+(?:\.\d+)?", s):
        out += [normal_form(s[at : m.start()]), m[0]]
        at = m.end()
    return " ".join(x for x in [*out, normal_form(s[at:])] if x)


@F.pandas_udf(BooleanType())
def unsafe_expression(s: pd.Series) -> pd.Series:
    """is_unsafe() of a column; a null text is safe."""
    return s.map(lambda x: is_unsafe(x or ""))


@F.pandas_udf(BooleanType())
def has_quotation(s: pd.Series) -> pd.Series:
    """is_quoting() of a column; a null text quotes nothing."""
    return s.map(lambda x: is_quoting(x or ""))


@F.pandas_udf(StringType())
def expression_normalize(s: pd.Series) -> pd.Series:
    """expression() of a column; null for a null text."""
    return s.map(lambda x: None if x is None else expression(x))


def stances(normal: Column) -> Column:
    """The decision stances that a normalised text takes, as an array in the order of STANCES."""
    return F.array_compact(F.array(*[F.when(normal.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(name)) for name, ps in STANCES.items()]))


def abstains(normal: Column) -> Column:
    return normal.rlike("|".join(f"(?:{p})" for p in ABSTENTIONS))


def content_tokens(normal: Column) -> Column:
    return F.filter(blank_split(normal), lambda x: ~x.isin(*JUDGE_STOPWORDS))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text between blanks or ends; an empty phrase does not."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def alnum_tokens(c: Column | str, least: int = 3) -> Column:
    """Distinct blank-parted tokens, lowered and without ASCII punctuation, of `least` or more characters."""
    bare = F.transform(blank_split(F.lower(F.coalesce(_col(c), F.lit("")))), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x) >= least))


def overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """The share of the query's tokens that the text has; 0 for a query without tokens."""
    return F.when(F.size(query_tokens) > 0, F.size(F.array_intersect(query_tokens, text_tokens)) / F.size(query_tokens)).otherwise(F.lit(0.0))


# Words that say nothing about a question's source.
MINING_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "was", "were", "is", "are", "be", "been", "being",
    "to", "of", "in", "on", "for", "from", "with", "by", "at", "as", "into", "about", "after", "before", "during", "over", "under", "between", "through",
    "which", "who", "whom", "whose", "what", "when", "where", "why", "how", "did", "does", "do", "has", "have", "had", "will", "would", "could", "should",
    "can", "may", "might", "their", "there", "they", "them", "he", "she", "his", "her", "its", "it", "we", "our", "you", "your", "i", "me", "my",
    "not", "no", "yes", "also", "just", "more", "most", "some", "any", "all", "one", "two", "three",
)


def mining_tokens(c: Column | str, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct tokens of [a-z0-9], 3 or more characters, not in the list."""
    bare = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(blank_split(bare), lambda x: (F.length(x) >= 3) & (~x.isin(*stopwords) if stopwords else F.lit(True))))


def truncate(c: Column | str, n: int = 1500) -> Column:
    return F.substring(_col(c), 1, n)


def paragraphs(c: Column | str, least: int = 80) -> Column:
    """Pieces between blank lines, without blanks around them, of `least` or more characters."""
    return F.filter(F.transform(F.split(_col(c), r"\n\s*\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= least)


# English number words.
_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


_SCALES = {"thousand": 1_000, "million": 1_000_000}
#: Words by kind, a letter each: u 1 to 9, z zero and 10 to 19, t tens, h, k, m, a for and, . for any other.
_KINDS = {w: "u" if 1 <= i <= 9 else "z" for i, w in enumerate(_UNITS)} | dict.fromkeys(_TENS, "t") | {"hundred": "h", "thousand": "k", "million": "m", "and": "a"}
_GROUP = "(?:tu?|u|z)(?:h(?:a?(?:tu?|u|z))?)?"
_NUMERAL = re.compile(f"{_GROUP}(?:[km](?:{_GROUP})?)*")


def _spoken(words: list[str]) -> set[float]:
    """Values of the English numerals below 10**9 in a list of words; numerals that stand side by side stay apart."""
    out: set[float] = set()
    for m in _NUMERAL.finditer("".join(_KINDS.get(w, ".") for w in words)):
        total = group = 0
        for w in words[m.start() : m.end()]:
            if w in _SCALES:
                total, group = total + group * _SCALES[w], 0
            elif w == "hundred":
                group *= 100
            elif w != "and":
                group += _UNITS.index(w) if w in _UNITS else 10 * (_TENS.index(w) + 2)
        out.add(float(total + group))
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def spoken_numbers(s: pd.Series) -> pd.Series:
    """Numbers that judge-normalised text has in words, sorted."""
    return s.map(lambda x: sorted(_spoken((x or "").split())))


def digit_numbers(normal: Column) -> Column:
    """Numbers that a text has in digits, distinct and sorted."""
    found = F.regexp_extract_all(normal, F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("double"))))


def numbers(normal: Column) -> Column:
    """Numbers in digits or words of a judge-normalised text, distinct and sorted."""
    return F.array_sort(F.array_union(digit_numbers(normal), spoken_numbers(normal)))


def is_year(x: Column) -> Column:
    return (x == F.floor(x)) & x.between(1900, 2100)


def last_year(c: Column | str) -> Column:
    """The last of 1900 to 2099 that stands in the text, or null."""
    return F.try_element_at(F.regexp_extract_all(_col(c), F.lit("((?:19|20)[0-9]{2})"), F.lit(1)), F.lit(-1)).cast("int")


def id_parent(c: Column | str) -> tuple[Column, Column]:
    """(parent, index) of ids that end in _digits; null where they don't."""
    whole = _col(c)
    ok = whole.rlike(r"(?s)^.*_\d+$")
    return (
        F.when(ok, F.regexp_extract(whole, r"(?s)^(.*)_(\d+)$", 1)),
        F.when(ok, F.regexp_extract(whole, r"(?s)^(.*)_(\d+)$", 2).cast("int")),
    )


def prompt(passages: Column, question: Column, template: str = "Context:\n{passages}\n\nQuestion: {question}\nAnswer:") -> Column:
    """The passages, a blank line between any two, and the question in a template."""
    before, rest = template.split("{passages}")
    between, after = rest.split("{question}")
    return F.concat(F.lit(before), F.array_join(passages, "\n\n"), F.lit(between), question, F.lit(after))


def judge_prompt(question: Column, gold: Column, answer: Column, false_premise: Column) -> Column:
    """The instruction for a judging model; a question with a false premise asks whether the answer rejects it."""
    rule = F.when(false_premise, F.lit("The question has a false premise. The answer is right only if it says so.")).otherwise(F.lit("The answer is right only if it agrees with the reference."))
    return F.format_string("%s\nQuestion: %s\nReference: %s\nAnswer: %s\nReply with JSON: {\"verdict\": true or false}", rule, question, gold, answer)


# --- questions, reviews and evidence ------------------------------------------------------------------------

# Words that carry no content, of ranked reviews.
REVIEW_STOPWORDS = (
    "what when where which who whom whose why how is was were are the a an of in on at to for from by did do does this that these those name year"
).split()


def ascii_words(c: Column | str, least: int = 3) -> Column:
    """Distinct whole words, lowered, that are of [a-z0-9] only and have `least` or more characters."""
    words = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) >= least) & x.rlike("^[a-z0-9]+$")))


def ascii_runs(c: Column | str) -> Column:
    """Distinct runs of [a-z0-9], lowered, wherever they stand."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))


def review_terms(c: Column | str) -> Column:
    """ascii_runs() of three or more characters that are no stopwords."""
    return F.filter(ascii_runs(c), lambda x: (F.length(x) >= 3) & ~x.isin(*REVIEW_STOPWORDS))


def match_form(c: Column | str) -> Column:
    """Lowered, ASCII punctuation deleted, blanks collapsed: the form in which answers are looked for in evidence."""
    return F.array_join(blank_split(F.translate(F.replace(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("ß"), F.lit("ss")), PUNCTUATION, "")), " ")


def appears_in(answer: Column | str, evidence: Column | str) -> Column:
    """Whether the answer's words stand in the evidence as whole words in sequence; an answer without words does not."""
    a, e = match_form(answer), match_form(evidence)
    # no letter, digit or mark of a word may touch it
    return (a != "") & F.regexp_like(e, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), a, F.lit(r"\E(?![\p{L}\p{N}_])")))


def clean_questions(rows: DataFrame, split: str, wanted: str | None, question: str, answer: str, others: Column) -> DataFrame:
    """rows of the wanted split (None: all), its case aside, with a question and an answer, trimmed, and `aliases`.

    aliases are the other answers that are neither blank nor the answer, each once, in order.
    """
    q, a = F.trim(question), F.trim(answer)
    rows = rows if wanted is None else rows.where(F.upper(F.trim(split)) == wanted.upper())
    more = F.transform(others, lambda x: F.trim(x))
    aliases = F.array_distinct(F.filter(more, lambda x: x.isNotNull() & (x != "") & (x != a)))
    return rows.select(*[c for c in rows.columns if c not in ("question", "answer", "aliases")], q.alias("question"), a.alias("answer"), aliases.alias("aliases")).where("question <> '' AND answer <> ''")
