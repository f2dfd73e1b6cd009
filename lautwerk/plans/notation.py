"""Rules as lines: ``p  ~  f  /  lect: [+vowel] _ #``, as column expressions over arrays of tokens ``slot:feature=value``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _of(tokens: Column, slot: str) -> Column:
    """Features of a slot's tokens, in order, as +f, -f or f=v."""
    own = F.filter(tokens, lambda t: F.startswith(t, F.lit(f"{slot}:")))
    bare = F.transform(own, lambda t: F.substring(t, F.lit(len(slot) + 2), F.length(t)))

    def sign(t: Column) -> Column:
        name, value = F.split_part(t, F.lit("="), F.lit(1)), F.split_part(t, F.lit("="), F.lit(2))
        return F.when(value == "+", F.concat(F.lit("+"), name)).when(value == "-", F.concat(F.lit("-"), name)).when(value == "", name).otherwise(F.concat(name, F.lit("="), value))

    return F.transform(F.array_sort(bare), sign)


def _bracket(features: Column, before: str = "", after: str = "") -> Column:
    return F.when(F.size(features) > 0, F.concat(F.lit(before), F.lit("["), F.array_join(features, ","), F.lit("]"), F.lit(after)))


def _distance(tokens: Column, side: str) -> Column:
    """Two and three away as one skeleton: · stands for what isn't named."""
    two, three = _bracket(_of(tokens, f"{side}@2")), _bracket(_of(tokens, f"{side}@3"))
    dot = F.lit("·")
    far = [three, F.coalesce(two, dot), dot] if side == "preceding" else [dot, F.coalesce(two, dot), three]
    near = [two, dot] if side == "preceding" else [dot, two]
    return F.when(three.isNotNull(), F.concat_ws(" ", *far)).when(two.isNotNull(), F.concat_ws(" ", *near))


def _somewhere(tokens: Column, side: str) -> Column:
    own = _of(tokens, f"somewhere_{side}")
    text = F.array_join(F.transform(own, lambda f: F.concat(F.lit("["), f, F.lit("]"))), " & ")
    return F.when(F.size(own) > 0, F.concat(text, F.lit(" …")) if side == "preceding" else F.concat(F.lit("… "), text))


def frame(tokens: Column) -> Column:
    """An environment from the outside in: edge, previous syllable, anything before, distances, neighbour, the target, and so on to the right; empty for none."""
    position = F.when(F.array_contains(tokens, "position:initial"), "initial").when(F.array_contains(tokens, "position:final"), "final").when(F.array_contains(tokens, "position:medial"), "medial")
    role = [F.when(F.size(_of(tokens, s)) > 0, F.concat(F.lit(f"{s}="), F.array_join(_of(tokens, s), ","))) for s in ("role", "syllable", "morpheme", "morpheme_index", "stress")]
    inner = F.concat_ws(",", *role)
    target = F.when(inner == "", F.lit("_")).otherwise(F.concat(F.lit("_["), inner, F.lit("]")))
    parts = [
        F.when(position == "initial", "#").when(position == "medial", "¬#"),
        _bracket(_of(tokens, "previous_syllable"), after="⁻"), _somewhere(tokens, "preceding"), _distance(tokens, "preceding"), _bracket(_of(tokens, "preceding")),
        target,
        _bracket(_of(tokens, "following")), _distance(tokens, "following"), _somewhere(tokens, "following"),
        _bracket(_of(tokens, "same_syllable"), after="⁼"), _bracket(_of(tokens, "next_syllable"), after="⁺"),
        F.when(position == "final", "#").when(position == "medial", "¬#"),
    ]
    return F.when(F.size(tokens) == 0, "").otherwise(F.concat_ws(" ", *parts))


def side(graphemes: Column) -> Column:
    """One side's outcome: a grapheme, a set in braces, the gap for none."""
    return F.when(F.size(graphemes) == 0, "∅").when(F.size(graphemes) == 1, F.element_at(graphemes, 1)).otherwise(F.concat(F.lit("{"), F.array_join(graphemes, ","), F.lit("}")))


def line(sides: list[tuple[Column, Column, Column]]) -> Column:
    """``A  ~  B  /  frames`` of sides (lect, graphemes, tokens); a frame has its lect before it unless all sides state the same one."""
    frames = F.array(*[frame(t) for _, _, t in sides])
    stated = F.filter(frames, lambda f: f != "")
    alike = (F.size(stated) == len(sides)) & (F.lit(len(sides)) > 1) & (F.size(F.array_distinct(frames)) == 1)
    named = F.concat_ws(" ;  ", *[F.when(frame(t) != "", F.concat(lect, F.lit(": "), frame(t))) for lect, _, t in sides])
    head = F.concat_ws("  ~  ", *[side(g) for _, g, _ in sides])
    return F.when(F.size(stated) == 0, head).when(alike, F.concat(head, F.lit("  /  "), F.element_at(frames, 1))).otherwise(F.concat(head, F.lit("  /  "), named))


def cross_dimensional(lect: Column, dimension: Column, value: Column, environment_lect: Column, tokens: Column) -> Column:
    """``lect [tone=4]  /  other: frame``; the frame's lect is named where it is another one."""
    head = F.concat(lect, F.lit(" ["), dimension, F.lit("="), value, F.lit("]"))
    f = frame(tokens)
    return F.when(f == "", head).when(environment_lect == lect, F.concat(head, F.lit("  /  "), f)).otherwise(F.concat(head, F.lit("  /  "), environment_lect, F.lit(": "), f))
