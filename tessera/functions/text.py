"""Names and labels: cleaning, aliases, first-match classes, chord symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separation models call a part, and the part's key.
ALIASES = {
    "vocals": "vocals", "vocal": "vocals", "lead vocals": "lead_vocal", "lead_vocals": "lead_vocal", "instrumental": "instrumental", "inst": "instrumental", "no vocals": "instrumental",
    "back vocals": "bgv", "backing vocals": "bgv", "bgv": "bgv", "drums": "drums", "bass": "bass", "other": "other", "guitar": "electric_guitar", "piano": "keys", "kick": "kick", "snare": "snare",
    "toms": "toms", "tom": "toms", "hh": "hihat", "hihat": "hihat", "hi-hat": "hihat", "ride": "cymbals", "crash": "cymbals", "cymbals": "cymbals",
}

#: Keys of channels that are routed away: the click, and what is no music.
CLICK, IGNORED = "__click", "__ignore"
# Patterns of recorded channels' names, tried in order, and the part each names.
CHANNELS = [
    (r"\b(click|metronome|cue)\b", "__click"),
    (r"\b(talkback|tb|com|intercom)\b", "__ignore"),
    (r"\b(kick|bd|bass\s*drum)\b", "kick"),
    (r"\b(snare|sn|sd)\b", "snare"),
    (r"\b(tom|rack|floor)\b", "toms"),
    (r"\b(hh|hi-?hat|hat)\b", "hihat"),
    (r"\b(oh|overhead|cymbal|ride|crash)\b", "cymbals"),
    (r"\b(drum|kit)\b", "drums"),
    (r"\b(bass|bs|di\s*bass|b\.?gtr)\b", "bass"),
    (r"\b(eg|e\.?gtr|elec.*gtr|electric|lead\s*gtr)\b", "electric_guitar"),
    (r"\b(ag|a\.?gtr|acoustic)\b", "acoustic_guitar"),
    (r"\b(gtr|guitar)\b", "electric_guitar"),
    (r"\b(pad|strings|synth|ambient)\b", "pads"),
    (r"\b(keys|key|piano|kb|rhodes|organ|wurli)\b", "keys"),
    (r"\b(bgv|bv|choir|backing|harmony|harm)\b", "bgv"),
    (r"\b(lead\s*vox|lead\s*vocal|lv|worship\s*leader|wl)\b", "lead_vocal"),
    (r"\b(vox|vocal|voc|mic|mc)\b", "lead_vocal"),
    (r"\b(track|playback|loop)\b", "pads"),
]
# The numbering before a channel's name, an instrument number that is glued to it, and a side after it.
NUMBERING = r"(?i)^\s*(?:tr(?:ack)?|ch(?:an(?:nel)?)?)?[\s_-]*[0-9]{1,3}[\s_-]*"
GLUED = r"\b([A-Za-z]{1,6})([0-9]{1,2})\b"
SIDE = r"[\s_(-]*(l|r|left|right)[\s_)-]*$"

# Section labels by name; those that are numbered.
LABELS = {"intro": "Intro", "verse": "Verse", "prechorus": "Pre-Chorus", "chorus": "Chorus", "bridge": "Bridge", "inst": "Instrumental", "solo": "Solo", "break": "Break", "outro": "Outro", "end": "End"}
NUMBERED = ["verse", "chorus", "bridge"]

# Chord qualities as semitones over the root.
QUALITIES = {"": [0, 4, 7], "m": [0, 3, 7], "7": [0, 4, 7, 10], "m7": [0, 3, 7, 10], "maj7": [0, 4, 7, 11], "sus4": [0, 5, 7], "sus2": [0, 2, 7], "dim": [0, 3, 6], "aug": [0, 4, 8]}
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def lookup(key: Column, table: dict) -> Column:
    """The table's value for key, null if it has none."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def spaced(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[-_]", " "), r"\s+", " "))


def alias_key(name: Column) -> Column:
    """A part's canonical key: its alias, else the name in snake case."""
    plain = spaced(name)
    snake = F.replace(plain, F.lit(" "), F.lit("_"))
    return F.coalesce(lookup(plain, ALIASES), lookup(snake, ALIASES), snake)


def channel_name(name: Column) -> Column:
    """A channel's name without file ending and leading numbering, and with letters and glued numbers apart."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)\.(wav|aif|aiff|flac|caf)$", ""), NUMBERING, "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[_-]", " "), GLUED, "$1 $2")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def channel_side(clean: Column) -> Column:
    """l, r or an empty string."""
    return F.substring(F.regexp_extract(F.lower(clean), SIDE, 1), 1, 1)


def channel_base(clean: Column) -> Column:
    """The clean name in lower case without its side: what patterns are looked for in."""
    return F.trim(F.regexp_replace(F.lower(clean), SIDE, ""))


def own_track(clean: Column) -> Column:
    """The key of a channel that no pattern knows."""
    plain = F.regexp_replace(F.lower(clean), r"[^a-z0-9]+", "_")
    return F.concat(F.lit("ch_"), F.coalesce(F.nullif(plain, F.lit("")), F.lit("unnamed")))


def first_match(name: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    out = None
    for pattern, key in rules:
        test = name.rlike(pattern)
        out = F.when(test, key) if out is None else out.when(test, key)
    return out.otherwise(otherwise)


def safe_name(text: Column, default: str = "Track") -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_() -]", "_"), r"\s+", " ")
    return F.coalesce(F.nullif(F.trim(plain), F.lit("")), F.lit(default))


def chord_root(symbol: Column) -> Column:
    letter, accidental = F.regexp_extract(symbol, r"^([A-G])", 1), F.regexp_extract(symbol, r"^[A-G]([#b]?)", 1)
    return F.pmod(lookup(letter, LETTERS) + F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0), F.lit(12))


def chord_quality(symbol: Column) -> Column:
    return F.regexp_extract(symbol, r"^[A-G][#b]?(.*)$", 1)


def chord_classes(symbol: Column, strict: bool = False) -> Column:
    """The chord's pitch classes in order; null for a quality that isn't known, or with strict an error."""
    steps = F.element_at(F.create_map(*(x for q, s in QUALITIES.items() for x in (F.lit(q), F.array(*(F.lit(k) for k in s))))), chord_quality(symbol))
    if strict:
        steps = F.when(symbol.isNull() | steps.isNotNull(), steps).otherwise(F.raise_error(F.concat(F.lit("no chord: "), symbol)))
    return F.array_sort(F.transform(steps, lambda s: F.pmod(chord_root(symbol) + s, F.lit(12))))


def display_label(label: Column, ordinal: Column) -> Column:
    """A section's name, with its number where sections of the kind are counted."""
    pretty = F.coalesce(lookup(label, LABELS), F.initcap(label))
    return F.when(label.isin(NUMBERED) & (ordinal > 0), F.concat(pretty, F.lit(" "), ordinal.cast("string"))).otherwise(pretty)


def export_name(part: Column, filename: Column) -> Column:
    """A part's file name: the catalogue's, else its key."""
    return F.coalesce(filename, part)


def position_text(label: Column, usable: Column, reason: Column, spread: Column) -> Column:
    """Whether a part can be split by position, in words."""
    yes = F.concat(label, F.lit(": can be split by position ("), reason, F.lit(", spread "), spread.cast("string"), F.lit(")"))
    return F.when(usable, yes).otherwise(F.concat(label, F.lit(": not splittable by position - "), reason))


def packed_color(rgb: Column) -> Column:
    """#rrggbb as a BGR number with the custom bit set."""
    part = lambda at: F.conv(F.substring(rgb, at, 2), 16, 10).cast("long")
    return (part(6) * 65536 + part(4) * 256 + part(2)).bitwiseOR(F.lit(0x1000000).cast("long"))
