"""Text expressions: cleaning, prompts, completions, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeprep.config import INSTRUCTION

# The 29 code points that Python's ``\s`` and ``str.strip`` treat as blank.
BLANKS = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)
# The same set for Java's regular expressions; spelling out the code points is far slower.
BLANK_PATTERN = r"(?U)[\s\x1c-\x1f]"
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s\x0b]"


def strip(text: Column) -> Column:
    """Cut blanks of any kind at both ends (bare ``trim`` cuts spaces only)."""
    return F.btrim(text, F.lit(BLANKS))


def clean_text(text: Column) -> Column:
    """Turn each run of blanks into one space and cut the ends."""
    return F.trim(F.regexp_replace(text, F.lit(f"{BLANK_PATTERN}+"), F.lit(" ")))


def prompt(text: Column, instruction: str = INSTRUCTION) -> Column:
    """Instruction, an empty line, then the text."""
    return F.concat(F.lit(f"{instruction}\n\n"), text)


def completion(codes: Column) -> Column:
    """Codes joined by a comma and a space."""
    return F.array_join(codes, ", ")


def causal_text(prompt_text: Column, completion_text: Column) -> Column:
    """Prompt directly followed by the completion."""
    return F.concat(prompt_text, completion_text)


def word_tokens(text: Column) -> Column:
    """Alphanumeric runs and single other signs, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def strip_prompt_echo(response: Column, prompt_text: Column) -> Column:
    """What the model added to the prompt it repeats."""
    return strip(F.replace(response, prompt_text, F.lit("")))
