"""Text and span expressions. All are JVM-side columns; none needs a Python worker."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters: letters, numbers and underscore in any script.
WORD = r"[\p{L}\p{N}_]"
# Characters that continue a word to the right: letters, decimal digits, super- and subscript digits.
RIGHT = r"[\p{L}\p{Nd}²³¹⁰⁴-⁹₀-₉]"
# Whitespace of any kind. Java's \s is ASCII only without the U flag.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
TAG = r"</?[a-z][a-z0-9]*[^<>]*>|<!--.*?-->"

# Names of classes, never mentions.
CLASS_NAMES = [
    "anatomical location",
    "animal",
    "statistical technique",
    "biomedical technique",
    "bacteria",
    "chemical",
    "dietary supplement",
    "disease",
    "disorder",
    "finding",
    "drug",
    "food",
    "gene",
    "human",
    "microbiome",
]
# Generic words, rejected alone ("theraphy" is spelled so).
GENERIC_WORDS = [
    "system",
    "systems",
    "axis",
    "model",
    "models",
    "response",
    "mechanism",
    "theraphy",
    "symptoms",
    "pathogenesis",
    "destruction",
]
HEADING = "Background"
# Characters of a piece of a text.
PART = 1024


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def normalise_surface(text: Column) -> Column:
    """Lower-case and strip whitespace of any kind."""
    return F.lower(F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", ""))


def mask_html(text: Column, replacement: str = "#") -> Column:
    """Cover tags and comments with as many replacement characters, so that offsets stay."""
    between = F.split(text, TAG, -1)
    masks = F.transform(
        F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), lambda tag: F.repeat(F.lit(replacement), F.length(tag))
    )
    pairs = F.arrays_zip(between.alias("text"), masks.alias("mask"))
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(p["text"], F.coalesce(p["mask"], F.lit("")))), ""
    )


def span_valid(span: Column, strict: bool = False) -> Column:
    """False for one character, a class name or a generic word.

    strict also rejects spans ending with a generic word and spans of punctuation only,
    and accepts the single characters C and A.
    """
    low = F.lower(span)
    valid = (F.length(span) != 1) & ~low.isin(CLASS_NAMES) & ~low.isin(GENERIC_WORDS)
    if not strict:
        return valid
    suffix = rf"\b({'|'.join(GENERIC_WORDS)})\z"
    return span.isin("C", "A") | (valid & ~low.rlike(suffix) & ~span.rlike(r"\A[,.\-'*;:<>!&#\s]*\z"))


def word_before(before: Column) -> Column:
    """Length of the run of word characters that ends `before`."""
    return F.length(F.regexp_extract(F.reverse(before), rf"\A{WORD}*", 0))


def run_after(after: Column, char_class: str = WORD) -> Column:
    """Length of the run of characters that begins `after`."""
    return F.length(F.regexp_extract(after, rf"\A{char_class}*", 0))


def span_runs(before: Column, span: Column, after: Column) -> Column:
    """Struct (strip, left, right): lengths of the junk that begins the span and of the words cut off beside it."""
    return F.struct(
        F.length(F.regexp_extract(span, rf"\A(?:[)\]#]|{SPACE})*", 0)).alias("strip"),
        word_before(before).alias("left"),
        run_after(after, RIGHT).alias("right"),
    )


def repair_span(before: Column, span: Column, after: Column, start: Column, end: Column, runs: Column) -> Column:
    """Struct (new_start, new_end) of the span cut free of leading junk and grown to whole words.

    `before` and `after` are the text beside the span, at least as far as its words reach; `runs` is their
    span_runs.

    The reading is a fixpoint of one-character steps: leading brackets, '#' or spaces are dropped; otherwise the
    start moves left while a word character precedes it; the end moves right while a letter or digit follows.
    Each of the three distances is a run length, so no loop is needed. A "Background" heading glued to the span
    stops the move left and is cut off. Needs start < end.
    """
    strip, left, right = runs["strip"], runs["left"], runs["right"]
    size = len(HEADING)

    # A stripped character is no word character, so stripping and moving left exclude each other.
    rest = F.concat(F.substring(span, strip + 1, F.length(span)), F.substring(after, F.lit(1), F.lit(size)))
    run = F.concat(F.substring(before, F.length(before) - left + 1, left), F.substring(rest, F.lit(1), F.lit(size - 1)))
    moved_left = (strip == 0) & (left > 0)

    def last_heading(part: Column) -> Column:
        return F.length(F.regexp_extract(part, rf"\A((?s:.*)){HEADING}", 1))

    # The heading met first on the way left is the last one that starts within the run. The end moves one character
    # a step as well: a heading the span began in may not be whole yet when its start is passed, and then the one
    # before it counts, if any. At the start of the run there is time for the end to catch up.
    met = last_heading(run)
    whole = (met == 0) | (end + F.least(left - met, right) >= start - left + met + size)
    earlier = F.substring(run, F.lit(1), met + size - 1)
    heading_in_run = moved_left & F.when(whole, run.contains(HEADING)).otherwise(earlier.contains(HEADING))
    to_heading = F.when(whole, met).otherwise(last_heading(earlier))
    # Otherwise a heading counts when it begins the span after some change.
    heading_first = ((strip > 0) | (right > 0)) & ~moved_left & rest.startswith(HEADING)
    new_start = (
        # Most texts hold no heading; then nothing of the above is looked for.
        F.when(~F.concat(before, span, after).contains(HEADING), F.when(strip > 0, start + strip).otherwise(start - left))
        .when(heading_in_run, start - left + to_heading + size)
        .when(heading_first, start + strip + size)
        .when(strip > 0, start + strip)
        .otherwise(start - left)
    )
    return F.struct(new_start.cast("int").alias("new_start"), (end + right).cast("int").alias("new_end"))


def orient_span(start: Column, end: Column) -> Column:
    """Struct (start_idx, end_idx) with a reversed span turned round."""
    return F.struct(F.least(start, end).alias("start_idx"), F.greatest(start, end).alias("end_idx"))


def span_core(span: Column) -> Column:
    """Struct (lead, core): the length of the whitespace that begins the span, and the span without any round it."""
    return F.struct(
        F.length(F.regexp_extract(span, rf"\A{SPACE}*", 0)).alias("lead"),
        F.regexp_replace(span, rf"\A{SPACE}+|{SPACE}+\z", "").alias("core"),
    )


def snap_to_tokens(before: Column, span: Column, after: Column, start: Column, cored: Column | None = None) -> Column:
    """Struct (new_start, new_end) of the tokens the span touches, null when it touches none.

    Tokens are runs of word characters and single other non-space characters, so the boundaries follow from the
    characters around the span and no token table has to be joined. `cored` is its span_core, where that is a column already.
    """
    cored = span_core(span) if cored is None else cored
    lead, core = cored["lead"], cored["core"]
    ends_span = lead + F.length(core) == F.length(span)
    to_left = F.when((lead == 0) & core.rlike(rf"\A{WORD}"), word_before(before)).otherwise(0)
    to_right = F.when(ends_span & core.rlike(rf"{WORD}\z"), run_after(after)).otherwise(0)
    return F.when(
        F.length(core) > 0,
        F.struct(
            (start + lead - to_left).cast("int").alias("new_start"),
            (start + lead + F.length(core) + to_right).cast("int").alias("new_end"),
        ),
    )


def text_parts(text: Column) -> Column:
    """The text in pieces of PART characters, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def slice_parts(parts: Column, start: Column, end: Column) -> Column:
    """As slice_text of the text that was cut by text_parts, for 0 <= start <= end <= its length.

    Reaching a character of a text means reading all before it; here only the pieces at both ends are read so.
    """
    first, last = F.floor(start / PART).cast("int"), F.floor(end / PART).cast("int")
    at, to = start - first * PART, end - last * PART

    def piece(k: Column) -> Column:
        return F.coalesce(F.get(parts, k), F.lit(""))

    across = F.concat(
        F.substring(piece(first), at + 1, F.lit(PART)),
        F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(piece(last), F.lit(1), to),
    )
    return F.when(first == last, F.substring(piece(first), at + 1, to - at)).otherwise(across)


def insert_markers(text: Column, s_start: Column, s_end: Column, o_start: Column, o_end: Column) -> Column:
    """Put [E1]..[/E1] round the subject and [E2]..[/E2] round the object.

    An overlapping later span is clipped to begin where the earlier one ends.
    """
    return _marked(s_start, s_end, o_start, o_end, lambda a, b: slice_text(text, a, b), F.length(text))


def insert_markers_in_parts(
    parts: Column, size: Column, s_start: Column, s_end: Column, o_start: Column, o_end: Column
) -> Column:
    """As insert_markers of a text given as text_parts and its length, both of which are computed once a text, not once a pair."""
    ends = [s_start, s_end, o_start, o_end]
    inside = (F.least(s_start, o_start) >= 0) & (F.greatest(s_end, o_end) <= size) & (s_start <= s_end) & (o_start <= o_end)
    return F.when(inside, _marked(*ends, lambda a, b: slice_parts(parts, a, b), size)).otherwise(insert_markers(F.array_join(parts, ""), *ends))


def _marked(s_start: Column, s_end: Column, o_start: Column, o_end: Column, cut: Callable[[Column, Column], Column], size: Column) -> Column:
    subject_first = s_start <= o_start

    def pick(if_subject, if_object):
        return F.when(subject_first, if_subject).otherwise(if_object)

    a_start, a_end = pick(s_start, o_start), pick(s_end, o_end)
    b_start = F.greatest(pick(o_start, s_start), a_end)
    b_end = F.greatest(pick(o_end, s_end), b_start)
    return F.concat(
        cut(F.lit(0), a_start),
        pick(F.lit("[E1]"), F.lit("[E2]")),
        cut(a_start, a_end),
        pick(F.lit("[/E1]"), F.lit("[/E2]")),
        cut(a_end, b_start),
        pick(F.lit("[E2]"), F.lit("[E1]")),
        cut(b_start, b_end),
        pick(F.lit("[/E2]"), F.lit("[/E1]")),
        cut(b_end, b_end + size),
    )
