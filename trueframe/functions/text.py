"""Caption, description and comment rules as Column expressions.

Word boundaries and digits are ASCII, as in the published rules; the Java
engine's own ``\\b`` follows letters of every script, so it is spelled out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import codes

WORD = "[0-9A-Za-z_]"
LEFT, RIGHT = f"(?<!{WORD})", f"(?!{WORD})"
BOUND = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
SPACE = r"[\s\x0B   -     　﻿]"
# the characters that SPACE stands for in Java, whose own \\s is these six
SPACES = "".join(c for c in map(chr, range(0x10000)) if re.fullmatch(SPACE.replace(r"\s", r" \t\n\x0B\f\r"), c))

# Generator products named in claims.
PRODUCTS = "veo|sora|runway|kling|hailuo|luma|pika|higgsfield"
TITLE_PRODUCTS = "veo|sora|runway|kling"

# Words that turn a caption statement into no claim.
NO_CLAIM_WORDS = ("not|no|never|without|isn't|isnt|wasn't|wasnt|tutorial|learn|review|example|"
                  "detector|detect|spot")
_SUBJECT = rf"^{SPACE}*(?:(?:this|the|my|our){SPACE}+(?:video|clip|reel|scene|footage){SPACE}+(?:(?:is|was){SPACE}+)?)?"
# Forms of a positive AI claim in a caption statement.
CLAIM_PATTERNS = (
    rf"(?i){_SUBJECT}(?:ai[- ]generated|generated (?:with|using|by) (?:generative )?ai|made (?:with|using) (?:generative )?ai){RIGHT}",
    rf"(?i)(?:^|{SPACE})#(?:aigenerated|aivideo|madewithai|syntheticmedia){RIGHT}",
    rf"(?i){_SUBJECT}(?:made|generated|created) (?:with|using|by) (?:{PRODUCTS}){RIGHT}",
)
# Disclosure wording of a description, with the reason code.
DISCLOSURE_PATTERNS = (
    (rf"(?i){LEFT}(?:ai|artificial intelligence)[ -]generated{RIGHT}", "description_ai_generated"),
    (rf"(?i){LEFT}generated (?:using|with|by) (?:generative )?(?:ai|artificial intelligence){RIGHT}", "description_ai_generator"),
    (rf"(?i){LEFT}made (?:using|with) (?:generative )?(?:ai|artificial intelligence){RIGHT}", "description_made_with_ai"),
    (rf"(?i){LEFT}(?:synthetic media|synthetic video|ai[ -]altered|ai[ -]created){RIGHT}", "description_synthetic_media"),
    (rf"(?i)#(?:aigenerated|syntheticmedia){RIGHT}", "description_hashtag"),
    (rf"(?i){LEFT}made (?:using|with) (?:{PRODUCTS}){RIGHT}", "description_names_generator"),
)
# What every claim pattern needs somewhere; one scan rules most captions out.
CLAIM_HINT = r"(?i)generated|made |created |#ai|#made|#synth"
TITLE_PATTERN = rf"(?i)^{SPACE}*[\[(]?(?:ai[ -]generated|synthetic media|made with (?:{TITLE_PRODUCTS}))[\])]?{SPACE}*[:|-]"
QUESTION_PATTERN = rf"(?i){LEFT}(?:is|was|could|might).{{0,30}}(?:ai[ -]generated|synthetic){RIGHT}"
DENIAL_PATTERN = (rf"(?i){LEFT}(?:not|no|never|without){RIGHT}.{{0,30}}{LEFT}(?:ai[ -]generated|"
                  rf"generated (?:using|with|by) (?:generative )?ai|synthetic media){RIGHT}")


def strip(text: Column) -> Column:
    """Trim every Unicode space, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def scrub_links(text: Column, limit: int = 2000) -> Column:
    """Links and bare domains replaced, control characters dropped, trimmed, cut
    to the caption length the report keeps; empty becomes null."""
    rest = rf"[^\s   ﻿<>\"']"
    one = F.regexp_replace(text, rf"(?i)(?:https?://|www\.){rest}+", "[link removed]")
    # a name begins at a word's start, or with a hyphen behind a word; a label that no dot follows is not tried again shorter
    two = F.regexp_replace(one, rf"(?i)(?:{LEFT}[a-z0-9]|(?<={WORD})-)[a-z0-9-]*+\.(?:[a-z0-9-]++\.)*[a-z]{{2,}}(?:/{rest}*)?", "[link removed]")
    three = F.regexp_replace(two, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.nullif(F.substring(strip(three), 1, limit), F.lit(""))


def caption_claim(caption: Column) -> Column:
    """Whether a caption positively says the post is AI-made; questions,
    negations and tutorial wording are no claims. Null caption: false."""
    said = F.filter(F.split(caption, rf"\n|(?<=[.!?]){SPACE}+"), lambda s: ~s.contains("?") & ~s.rlike(
        rf"(?i){LEFT}(?:{NO_CLAIM_WORDS}){RIGHT}"))
    claimed = F.exists(said, lambda s: s.rlike(CLAIM_PATTERNS[0]) | s.rlike(CLAIM_PATTERNS[1]) | s.rlike(CLAIM_PATTERNS[2]))
    return F.coalesce(F.when(caption.rlike(CLAIM_HINT), claimed), F.lit(False))


def disclosure_codes(title: Column, description: Column) -> Column:
    """Reasons a title or description discloses synthetic media."""
    lines = F.filter(F.split(description, r"\r?\n"), lambda s: ~(s.contains("?") & s.rlike(QUESTION_PATTERN)) & ~s.rlike(DENIAL_PATTERN))
    text = F.array_join(lines, "\n")
    return codes((title.rlike(TITLE_PATTERN), "title_label"),
                 *[(text.rlike(pattern), code) for pattern, code in DISCLOSURE_PATTERNS])


def one_line(text: Column, limit: int = 800) -> Column:
    """White space collapsed, cut to the length a comment batch carries."""
    return F.substring(F.regexp_replace(text, rf"{SPACE}+", " "), 1, limit)
