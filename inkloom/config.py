"""Settings of the layout rules. Lengths are relative to the character height or the page."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

# Names and defaults that results depend on.
LABELS = ("header", "footer", "main_text", "side_text", "filler")


@dataclass(frozen=True)
class Settings:
    work_max_side: int = 1800
    illum_kernel_frac: float = 0.04
    deskew: bool = True
    max_skew_deg: float = 10.0
    min_skew_deg: float = 0.3
    page_bg_delta: float = 18.0
    page_min_area_frac: float = 0.15
    page_edge_erode_frac: float = 0.012
    sauvola_window_frac: float = 0.025
    sauvola_k: float = 0.25
    min_component_px: int = 12
    rule_line_len_frac: float = 0.35
    smear_x: float = 1.1
    smear_y: float = 0.15
    row_merge_gap: float = 2.0
    tall_line_split: float = 1.5
    core_width_frac: float = 0.5
    gap_pitch_factor: float = 1.35
    side_margin_tol: float = 0.6
    latin_threshold: float = 0.55
    pencil_contrast_ratio: float = 0.55
    use_ocr_script_check: bool = True
    merge_dy_pitch: float = 0.9
    merge_dx_char: float = 1.5

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Overrides by name; an unknown name is a KeyError, a value of another type a TypeError."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        values = json.loads(text)
        for k, v in values.items():
            if k not in kinds:
                raise KeyError(k)
            if not isinstance(v, (int, float) if kinds[k] is float else kinds[k]) or (isinstance(v, bool) and kinds[k] is not bool):
                raise TypeError(f"{k}: {kinds[k].__name__} expected")
        return cls(**values)
