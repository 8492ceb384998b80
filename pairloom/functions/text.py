"""Text expressions: strip, normalise, passages, prompts, answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Separators, the non-ASCII pattern and the prompt document length.
SEPARATOR = " "
DUAL_SEPARATOR = " [SEP] "
NON_ASCII = r"[^\x00-\x7F]"
PROMPT_CHARACTERS = 2000
# Fixed value: the characters that count as white space when a text is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def norm_query(text: Column) -> Column:
    """Form used when queries are compared."""
    return strip(F.lower(text))


def doc_truncate(text: Column, characters: int = PROMPT_CHARACTERS) -> Column:
    """The part of a document that is put into a prompt (the limit is the feature)."""
    return F.substring(text, 1, characters)


def ascii_strip(text: Column) -> Column:
    return F.regexp_replace(text, NON_ASCII, "")


def passage_text(title: Column, text: Column, sep: str = SEPARATOR) -> Column:
    """``title + sep + text`` as used when training pairs are built; a missing title is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(sep), text)


def passage_for_encoder(title: Column, text: Column, sep: str = SEPARATOR) -> Column:
    """Encoder form: stripped, and the text alone where the title is absent (NULL)."""
    return F.when(title.isNull(), strip(text)).otherwise(
        strip(F.concat(title, F.lit(sep), text))
    )


def dual_tag(text: Column, side: str) -> Column:
    """Tag a text for a two-tower model: a struct with the one field ``query`` or ``doc``."""
    if side not in ("query", "doc"):
        raise ValueError(f"side must be 'query' or 'doc', got {side!r}")
    return F.struct(text.alias(side))


def first_word(text: Column) -> Column:
    word = F.element_at(F.split(norm_query(text), " "), 1)
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 2**31 - 1))


def answer_extract(completion: Column, prompt: Column, compat_drop_last: bool = True) -> Column:
    """The answer behind an echoed prompt: up to the first line break, stripped.

    Without a line break the last character is lost (``compat_drop_last``), as downstream
    results depend on it; pass False to keep it.
    """
    answer = completion.substr(F.length(prompt) + 1, F.length(completion))
    whole = answer.substr(F.lit(1), F.length(answer) - 1) if compat_drop_last else answer
    return strip(
        F.when(F.instr(answer, "\n") > 0, F.substring_index(answer, "\n", 1)).otherwise(whole)
    )


def prompt_build(template: str, values: list[Column], next_step: str = "") -> Column:
    """Fill ``{}`` holes left to right; surplus values are ignored.

    The template is cut once on the driver, so braces or ``$`` inside a text stay as they are.
    """
    parts = template.split("{}")
    holes = len(parts) - 1
    if holes > len(values):
        raise ValueError(f"the template has {holes} holes but only {len(values)} values")
    pieces = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        pieces += [value, F.lit(part)]
    return F.concat(*pieces, F.lit(next_step))


def sim_of_name(model: Column) -> Column:
    """Similarity read off a model name; ``cos_sim`` is looked for first."""
    return (
        F.when(model.contains("cos_sim"), "cos_sim")
        .when(model.contains("dot_score"), "dot_score")
        .otherwise("")
    )


def split_of(dataset: Column) -> Column:
    """Evaluation split of a collection: ``dev`` for msmarco, else ``test``."""
    return F.when(dataset == "msmarco", "dev").otherwise("test")
