"""Row-local text expressions: strip, tokenise, detokenise, token predicates.

All functions return ``Column`` expressions that stay inside whole-stage
codegen.  Regular expressions use explicit ``\\p{..}`` classes so that the
Java engine in Spark and RE2 in the DuckDB oracle agree character by character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (they define the semantics and must not change).
#
# * PUNCTUATION: the 32 ASCII punctuation characters, in code-point order.  A
#   token is rejected when it is a substring of this string (so "()" is
#   rejected, "--" is kept, and the empty string is rejected).
# * NUMBER_PATTERN: integers and decimals with an optional sign ("1", "3.68",
#   ".5"; not "3s1" and not "1,000").
# * Unicode whitespace (what Python's str.strip removes): the separator
#   categories Z*, the ASCII controls TAB LF VT FF CR, the information
#   separators U+001C..U+001F and NEXT LINE U+0085.
# ---------------------------------------------------------------------------
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# * ENGLISH_STOP_WORDS: the 179-word English stop list of the NLTK stopwords
#   corpus (the list the original preprocessing filters with), in its order.
#   It contains the contraction fragments ("didn", "ll", "t") that a
#   tokeniser splitting at apostrophes produces.  German uses the German list
#   of the same corpus as bundled with Spark ML (see ``stop_words``).
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split())
NUMBER_PATTERN = r"\A[+-]?(\p{Nd}+(\.\p{Nd}+)?|\.\p{Nd}+)\z"
WHITESPACE_CLASS = r"\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85"

STRIP_PATTERN = rf"\A[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+\z"
# A token is a run of letters/marks/digits/underscore, or any other single
# non-whitespace character (punctuation, symbols, emoji).
TOKEN_PATTERN = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_{WHITESPACE_CLASS}]"
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]"
# Sub-word piece marker used by piece tokenisers ("▁", LOWER ONE EIGHTH BLOCK).
PIECE_MARK = "▁"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim all Unicode whitespace at both ends (Spark's ``trim`` only trims spaces)."""
    return F.regexp_replace(_col(c), STRIP_PATTERN, "")


def tokenize(c) -> Column:
    """Text -> ARRAY<STRING> of word runs and single non-space symbols; blanks dropped."""
    return F.regexp_extract_all(_col(c), F.lit(TOKEN_PATTERN), 0)


def tokenized_text(c) -> Column:
    """Tokens joined by single spaces (the tokenised corpus line)."""
    return F.array_join(tokenize(c), " ")


def to_pieces(c) -> Column:
    """Word tokens -> sub-word style pieces: a piece marker before every token that
    starts a whitespace-separated word (the shape a piece tokeniser emits)."""
    marked = F.regexp_replace(_col(c), rf"(\A|[{WHITESPACE_CLASS}]+)([^{WHITESPACE_CLASS}])", rf" {PIECE_MARK}$2")
    return tokenize_pieces(marked)


def tokenize_pieces(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(rf"{PIECE_MARK}?(?:{TOKEN_PATTERN})"), 0)


def detokenize(pieces) -> Column:
    """Sub-word pieces -> text: concatenate, marker -> space, drop the leading space."""
    return F.ltrim(F.replace(F.array_join(_col(pieces), ""), F.lit(PIECE_MARK), F.lit(" ")))


def is_punct(token) -> Column:
    """True when the token is a substring of the ASCII punctuation string."""
    return F.contains(F.lit(PUNCTUATION), _col(token))


def is_number(token) -> Column:
    return _col(token).rlike(NUMBER_PATTERN)


# Fixed value: the German stop list of Spark ML (Snowball's list).
GERMAN_STOP_WORDS = tuple("""
    aber alle allem allen aller alles als also am an ander andere anderem anderen anderer anderes anderm andern
    anderr anders auch auf aus bei bin bis bist da damit dann der den des dem die das daß derselbe derselben
    denselben desselben demselben dieselbe dieselben dasselbe dazu dein deine deinem deinen deiner deines denn
    derer dessen dich dir du dies diese diesem diesen dieser dieses doch dort durch ein eine einem einen einer
    eines einig einige einigem einigen einiger einiges einmal er ihn ihm es etwas euer eure eurem euren eurer
    eures für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich mich mir ihr ihre ihrem ihren
    ihrer ihres euch im in indem ins ist jede jedem jeden jeder jedes jene jenem jenen jener jenes jetzt kann kein
    keine keinem keinen keiner keines können könnte machen man manche manchem manchen mancher manches mein meine
    meinem meinen meiner meines mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sein seine seinem
    seinen seiner seines selbst sich sie ihnen sind so solche solchem solchen solcher solches soll sollte sondern
    sonst über um und uns unse unsem unsen unser unses unter viel vom von vor während war waren warst was weg weil
    weiter welche welchem welchen welcher welches wenn werde werden wie wieder will wir wird wirst wo wollen
    wollte würde würden zu zum zur zwar zwischen
""".split())


def stop_words(language: str) -> tuple[str, ...]:
    """The stop list of ``language``."""
    return {"english": ENGLISH_STOP_WORDS, "german": GERMAN_STOP_WORDS}[language]


def stop_language(lang) -> Column:
    """German uses the German list; every other language falls back to English."""
    return F.when(F.lower(_col(lang)) == "de", F.lit("german")).otherwise(F.lit("english"))


def _sql_string(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _stop_list_sql(language: str) -> str:
    return ", ".join(_sql_string(w) for w in stop_words(language))


def is_stop(token, lang) -> Column:
    """Case-sensitive membership in the language's stop list (an InSet, no join).
    With column names the list is handed to the parser as one SQL expression
    (one call to the JVM instead of one per word)."""
    if isinstance(token, str) and isinstance(lang, str):
        t, g = f"`{token}`", f"`{lang}`"
        return F.expr(f"CASE WHEN lower({g}) = 'de' THEN {t} IN ({_stop_list_sql('german')}) "
                      f"ELSE {t} IN ({_stop_list_sql('english')}) END")
    german = _col(token).isin(list(stop_words("german")))
    english = _col(token).isin(list(stop_words("english")))
    return F.when(F.lower(_col(lang)) == "de", german).otherwise(english)


def admitted(token, lang) -> Column:
    """A token counts for the frequency statistic unless it is punctuation, a
    number or a stop word."""
    return ~is_punct(token) & ~is_number(token) & ~is_stop(token, lang)


def admitted_tokens(tokens: str, lang: str) -> Column:
    """The admitted tokens of an array column, as one SQL expression (as :func:`is_stop`)."""
    number = _sql_string(NUMBER_PATTERN)
    return F.expr(f"filter(`{tokens}`, t -> NOT contains({_sql_string(PUNCTUATION)}, t) AND NOT t RLIKE {number} AND NOT "
                  f"(CASE WHEN lower(`{lang}`) = 'de' THEN t IN ({_stop_list_sql('german')}) ELSE t IN ({_stop_list_sql('english')}) END))")


def split_words(c) -> Column:
    """``str.split(' ')`` semantics: split on single spaces, keep empty fields."""
    return F.split(_col(c), " ", -1)
