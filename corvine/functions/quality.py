"""How legible a text is: tokens that no writing system makes, replacement and control characters.

All of it is expressions over the array of a text's tokens, so it runs inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALPHA, _UP, _LOW = r"\p{IsAlphabetic}", r"\p{IsUppercase}", r"\p{IsLowercase}"
#: Writing systems as ranges of code points; letters outside of all are one more. Fixed values.
_SCRIPTS = [
    r"\x{0000}-\x{024F}", r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}", r"\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}", r"\x{0590}-\x{05FF}",
    r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}", r"\x{0900}-\x{097F}", r"\x{0E00}-\x{0E7F}", r"\x{3040}-\x{30FF}",
    r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}", r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}",
]
#: Places (of no width) where the case turns, where digits and letters meet, and where the writing system changes.
CASE_TURN = f"(?<={_LOW})(?={_UP})|(?<={_UP})(?={_LOW})"
DIGIT_TURN = f"(?<=[0-9])(?={_ALPHA})|(?<={_ALPHA})(?=[0-9])"
_others = lambda r: f"(?<=[{_ALPHA}&&[{r}]])(?=[{_ALPHA}&&[^{r}]])"
SCRIPT_TURN = "|".join([*map(_others, _SCRIPTS), f"(?<=[{_ALPHA}&&[^{''.join(_SCRIPTS)}]])(?=[{_ALPHA}&&[{''.join(_SCRIPTS)}]])"])
#: What an unstable or noisy token must have, whatever else.
_ODD = rf"[0-9]|{_UP}.*{_UP}|[^\x{{0000}}-\x{{024F}}]"
#: Tokens of code: with these marks, or with signs of angle or an inner dot.
_STRONG = r"://|/|_|::|->|=>|=|[(){}\[\]]"
_WEAK = rf"{_STRONG}|[<>]|[{_ALPHA}\p{{N}}_]\.[{_ALPHA}\p{{N}}_]"


def _count(token: Column, pattern: str) -> Column:
    return F.regexp_count(token, F.lit(pattern))


def clean_token(token: Column) -> Column:
    """Without marks at its ends other than ``_ - / .``."""
    edge = rf"[^{_ALPHA}\p{{N}}_\-/.]+"
    return F.regexp_replace(token, f"^{edge}|{edge}$", "")


def is_unstable(token: Column) -> Column:
    """A clean token of four letters or more whose case, digits or writing system change as in no word or identifier."""
    letters, digits, up, low = (_count(token, p) for p in (_ALPHA, "[0-9]", _UP, _LOW))
    turns, mixed = _count(token, CASE_TURN), (up > 0) & (low > 0)
    turbulent = mixed & (turns >= 3) & (token.rlike(f"(?<=[^{_UP}]){_UP}{{2}}") | (digits > 0))
    compact = (F.length(token) <= 5) & (up >= 2) & (low >= 2) & (turns >= 3)
    embedded = (digits > 0) & ((_count(token, DIGIT_TURN) >= 1) | ((up >= 2) & (low >= 2)))
    scripts = token.rlike(r"[^\x{0000}-\x{024F}]") & (_count(token, SCRIPT_TURN) >= 2)
    loud = (digits > 0) & (low == 0) & (up >= 5)
    stable = F.contains(token, F.lit("://")) | (_count(token, "/") >= 2) | (_count(token, "_") >= 2)
    return (F.length(token) >= 4) & ~stable & (letters >= 4) & (turbulent | compact | embedded | scripts | loud)


def is_noise(token: Column) -> Column:
    """A clean token of three letters or more with digits among them, or of two changes of the writing system."""
    scripts = token.rlike(r"[^\x{0000}-\x{024F}]") & (_count(token, SCRIPT_TURN) >= 2)
    return (F.length(token) >= 4) & (_count(token, _ALPHA) >= 3) & (token.rlike(DIGIT_TURN) | scripts)


def assess(text: Column) -> Column:
    """A struct of score, low_confidence, unstable_ratio, unstable, tokens and reasons.

    Texts under 24 characters are good.  Noise in a text that looks like code counts only where it
    dominates.  A text of low confidence scores 0.3 at most.  Null texts count as empty.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    good = _result(F.lit(1.0), F.lit(False), F.lit(0.0), F.lit(0), F.lit(0), F.array().cast("array<string>"))
    return _once(body, lambda b: F.when(F.length(b) < 24, good).otherwise(_once(_lists(b), lambda x: _once(_counted(x), _judge))))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once: a lambda's variable has it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _lists(body: Column) -> Column:
    """The text, its tokens between white space, and those without marks at their ends."""
    raw = F.filter(F.split(body, r"\s+"), lambda t: t != "")
    return _once(raw, lambda r: F.struct(
        body.alias("body"), F.filter(F.transform(r, clean_token), lambda t: t.rlike(rf"[{_ALPHA}\p{{N}}]")).alias("tokens"),
        F.filter(F.transform(r, lambda t: F.regexp_replace(t, r"^[,;:.?!]+|[,;:.?!]+$", "")), lambda t: t.rlike(_WEAK)).alias("marked"),
    ))


def _counted(x: Column) -> Column:
    body, tokens = x["body"], x["tokens"]
    # most tokens are plain words: only those with digits, two capitals or other writing systems can be unstable or noise
    odd = F.filter(tokens, lambda t: t.rlike(_ODD))
    return F.struct(
        F.greatest(F.length(body), F.lit(1)).alias("chars"), _count(body, "�").alias("replaced"), _count(body, r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]").alias("control"),
        F.size(tokens).alias("n"), F.size(F.filter(odd, is_unstable)).alias("unstable"), F.size(F.filter(odd, is_noise)).alias("noise"),
        F.size(F.filter(x["marked"], lambda t: t.rlike(_STRONG))).alias("strong"), F.size(x["marked"]).alias("marked"),
    )


def _result(score: Column, low: Column, share: Column, unstable: Column, tokens: Column, reasons: Column) -> Column:
    return F.struct(score.alias("score"), low.alias("low_confidence"), share.alias("unstable_ratio"), unstable.alias("unstable"), tokens.alias("tokens"), reasons.alias("reasons"))


def _judge(c: Column) -> Column:
    share = lambda x, of: F.when(of > 0, x / of).otherwise(0.0)
    n, unstable, noise, marked, strong = c["n"], c["unstable"], c["noise"], c["marked"], c["strong"]
    bad, odd, mark = share(unstable, n), share(noise, n), share(marked, n)
    code = (n > 0) & (((strong >= 2) & (mark >= 0.10)) | ((strong >= 1) & (marked >= 5) & (mark >= 0.18)) | ((marked >= 8) & (mark >= 0.25)))
    replaced, control = c["replaced"] / c["chars"], c["control"] / c["chars"]
    dense = ~code & (unstable >= 4) & (bad >= 0.18)
    wide = ~code & (unstable >= 8) & (bad >= 0.12)
    digits = ~code & (noise >= 3) & (odd >= 0.08)
    dominant = (unstable >= 12) & (bad >= 0.35) & ((noise >= 8) | (odd >= 0.12))
    penalty = bad * F.when(dense | wide | dominant, 1.35).otherwise(0.85)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - penalty - replaced * 8.0 - control * 8.0))
    low = (replaced >= 0.01) | (control >= 0.01) | dense | dominant | digits | (wide & (score < 0.75))
    say = lambda when, name: F.when(when, F.lit(name))
    reasons = F.array_compact(F.array(
        say(replaced >= 0.01, "replacement_chars"), say(control >= 0.01, "control_chars"), say(dense, "dense_unstable_tokens"), say(wide & ~dense, "widespread_unstable_tokens"),
        say(digits, "dense_digit_or_script_noise"), say(dominant, "dominant_structural_noise"),
    ))
    return _result(F.when(low, F.least(score, F.lit(0.3))).otherwise(score), low, bad, unstable, n, reasons)
