"""Settings of a decomposition, passed to the transforms as one value."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Options:
    """Each is read by plans/decompose.py: how splits are weighted and sharpened, what verdicts and repairs may do, and what is done to the parts."""

    separation_power: float = 2.0
    exact: bool = True
    refine_rounds: int = 0
    power_end: float = 5.0
    keep_uncertain: bool = True
    restore: bool = True
    max_gap_ms: float = 250.0
    tolerance_db: float = 1.5
    steady_tempo: bool = False
    semitones: int = 0

    def merged(self, given: dict[str, Any]) -> Options:
        """These settings with the known ones of given; unknown names are ignored."""
        names = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in given.items() if k in names})


# The component tree: part, parent, label, file name, colour, whether it is optional.
PART_TREE = [
    ("mix", None, "Original Mix", "00_Original_Mix", "#444c5c", False),
    ("vocals", "mix", "All Vocals", "10_Vocals_All", "#e0685a", False),
    ("lead_vocal", "vocals", "Lead Vocal", "11_Lead_Vocal", "#e0685a", False),
    ("bgv", "vocals", "Background Vocals", "12_BGVs", "#e8917f", False),
    ("instrumental", "mix", "Instrumental", "20_Instrumental", "#4f8a76", False),
    ("drums", "instrumental", "Drums", "30_Drums", "#c99a3e", False),
    ("kick", "drums", "Kick", "31_Kick", "#c99a3e", True),
    ("snare", "drums", "Snare", "32_Snare", "#c99a3e", True),
    ("toms", "drums", "Toms", "33_Toms", "#c99a3e", True),
    ("hihat", "drums", "Hi-Hat", "34_HiHat", "#c99a3e", True),
    ("cymbals", "drums", "Cymbals / OH", "35_Cymbals", "#c99a3e", True),
    ("bass", "instrumental", "Bass", "40_Bass", "#8a6fb0", False),
    ("electric_guitar", "instrumental", "Guitars", "50_Guitars", "#5b8fc9", False),
    ("keys", "instrumental", "Piano / Keys", "60_Keys", "#4aa3a3", False),
    ("pads", "instrumental", "Pads / Synth / Strings", "70_Pads_Synth", "#9b7fb0", False),
]
# How a parent is split: its parts, their residual, whether that is made (parent less the others) where it has no estimate, and the fewest estimates.
SPLITS = [
    ("mix", ["vocals", "instrumental"], "instrumental", True, 1),
    ("vocals", ["lead_vocal", "bgv"], "bgv", False, 2),
    ("instrumental", ["drums", "bass", "electric_guitar", "keys", "pads"], "pads", True, 1),
    ("drums", ["kick", "snare", "toms", "hihat", "cymbals"], "cymbals", False, 2),
]
