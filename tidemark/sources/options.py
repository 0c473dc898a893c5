"""Options of a run's stages, resolved from its flat settings: a default for what is absent or blank, an error for what is out of range."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..functions.coerce import FALSE, TRUE


def _blank(value: Any) -> bool:
    return value is None or (isinstance(value, str) and not value.strip())


def boolean(value: Any, default: bool, key: str) -> bool:
    if _blank(value):
        return default
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    if word in TRUE or word in FALSE:
        return word in TRUE
    raise ValueError(f"{key} must be a boolean")


def text(value: Any, default: str, key: str) -> str:
    return default if _blank(value) else str(value).strip()


def lower(value: Any, default: str, key: str) -> str:
    return text(value, default, key).lower()


def _number(value: Any, default: float | None, key: str, fits: Callable[[float], bool], kind: type) -> Any:
    if _blank(value):
        return default
    try:
        found = kind(value if not isinstance(value, str) else value.strip())
    except (TypeError, ValueError):
        raise ValueError(f"{key} must be a number") from None
    if isinstance(value, bool) or not fits(found) or (kind is int and found != float(value)):
        raise ValueError(f"{key} is out of range")
    return found


def positive(value: Any, default: float | None, key: str) -> float | None:
    return _number(value, default, key, lambda x: x > 0, float)


def nonnegative(value: Any, default: float, key: str) -> float:
    return _number(value, default, key, lambda x: x >= 0, float)


def whole(value: Any, default: int, key: str) -> int:
    return _number(value, default, key, lambda x: x > 0, int)


def count(value: Any, default: int, key: str) -> int:
    return _number(value, default, key, lambda x: x >= 0, int)


def strings(value: Any, default: list[str], key: str) -> list[str]:
    if _blank(value):
        return list(default)
    items = value if isinstance(value, list | tuple) else str(value).split(",")
    return [str(x).strip() for x in items if str(x).strip()] or list(default)


def optional_text(value: Any, default: None, key: str) -> str | None:
    return None if _blank(value) else str(value).strip()


def optional_number(value: Any, default: None, key: str) -> float | None:
    return _number(value, default, key, lambda x: True, float)


# Keys of the visual settings with their kinds and defaults
VISUAL: dict[str, tuple[Callable, Any]] = {
    "frame_interval_seconds": (positive, 10.0),
    "frame_smoke_seconds": (positive, None),
    "max_keyframes": (whole, 30),
    "min_visual_difference_score": (nonnegative, 0.12),
    "min_stable_duration_seconds": (nonnegative, 20.0),
    "min_frame_variance": (nonnegative, 2.0),
    "min_sharpness_score": (nonnegative, 1.5),
    "dark_frame_mean_threshold": (nonnegative, 5.0),
    "bright_frame_mean_threshold": (nonnegative, 250.0),
    "solid_frame_variance_threshold": (nonnegative, 2.0),
    "duplicate_similarity_threshold": (nonnegative, 0.92),
    "duplicate_hash_distance_threshold": (nonnegative, 0.08),
    "comparison_region_mode": (text, "full_frame"),
    "comparison_center_crop_percent": (positive, 1.0),
    "comparison_crop_left": (optional_number, None),
    "comparison_crop_top": (optional_number, None),
    "comparison_crop_right": (optional_number, None),
    "comparison_crop_bottom": (optional_number, None),
    "ocr_backend": (text, "none"),
    "ocr_language": (optional_text, None),
    "ocr_max_chars": (whole, 500),
    "ocr_min_text_length": (whole, 4),
    "min_keyframe_height": (whole, 1080),
    "animation_collapse_enabled": (boolean, True),
    "collapse_window_seconds": (positive, 90.0),
    "build_group_max_gap_seconds": (positive, 40.0),
    "max_intermediate_keyframes_per_group": (whole, 1),
    "build_group_similarity_threshold": (nonnegative, 0.45),
    "build_group_hash_distance_threshold": (nonnegative, 0.35),
    "min_scene_change_score": (nonnegative, 0.55),
    "final_state_preference": (text, "fuller_final_state"),
    "collapse_report_enabled": (boolean, True),
    "fuller_state_scoring_enabled": (boolean, True),
    "fuller_state_weight": (nonnegative, 1.0),
    "time_preference_weight": (nonnegative, 0.08),
    "content_area_weight": (nonnegative, 0.45),
    "detail_density_weight": (nonnegative, 0.25),
    "layout_richness_weight": (nonnegative, 0.30),
    "conservative_group_merge_enabled": (boolean, True),
    "group_merge_max_gap_seconds": (positive, 150.0),
    "group_merge_min_continuity_score": (nonnegative, 0.72),
    "title_region_max_difference": (nonnegative, 0.14),
    "fuller_replacement_min_delta": (nonnegative, 0.01),
    "report_group_decisions_limit": (whole, 200),
    "final_state_trace_enabled": (boolean, True),
    "final_state_trace_report_limit": (whole, 50),
    "low_content_lookahead_enabled": (boolean, True),
    "low_content_lookahead_seconds": (positive, 180.0),
    "low_content_content_area_threshold": (nonnegative, 0.12),
    "low_content_detail_density_threshold": (nonnegative, 0.10),
    "low_content_layout_richness_threshold": (nonnegative, 0.30),
    "low_content_title_region_max_difference": (nonnegative, 0.22),
    "low_content_slide_region_max_difference": (nonnegative, 0.70),
    "title_only_penalty_enabled": (boolean, True),
    "title_slide_keep_policy": (text, "keep_if_no_fuller_same_context"),
    "group_fullness_reset_min_delta": (nonnegative, 0.18),
    "strong_title_region_max_difference": (nonnegative, 0.08),
    "strong_title_group_merge_max_gap_seconds": (positive, 300.0),
    "strong_title_build_group_hash_distance_threshold": (nonnegative, 0.45),
    "adaptive_rescan_enabled": (boolean, False),
    "adaptive_rescan_interval_seconds": (positive, 2.0),
    "adaptive_rescan_window_seconds": (positive, 90.0),
}
# Keys of the acquisition's and the transcription's settings
ACQUISITION: dict[str, tuple[Callable, Any]] = {
    "min_video_height": (whole, 1080),
    "allow_video_resolution_fallback": (boolean, True),
    "resolution_fallback_strategy": (lower, "best_available"),
    "yt_dlp_format": (optional_text, None),
}
TRANSCRIPTION: dict[str, tuple[Callable, Any]] = {
    "transcription_backend": (text, "faster-whisper"),
    "transcription_model": (text, "base"),
    "transcription_device": (text, "cpu"),
    "transcription_compute_type": (text, "int8"),
    "transcription_language": (optional_text, None),
    "transcription_smoke_seconds": (positive, None),
}
# Keys of a content map's settings with their kinds and defaults
CONTENT_MAP: dict[str, tuple[Callable, Any]] = {
    "generate_content_map": (boolean, True),
    "generate_review_report": (boolean, True),
    "generate_lecture_handout": (boolean, True),
    "content_generation_backend": (lower, "none"),
    "content_generation_backend_mode": (lower, "skeleton"),
    "generate_llm_prompt_pack": (boolean, True),
    "llm_prompt_pack_path": (text, "audit/handout_prompt_pack.jsonl"),
    "content_unit_max_gap_seconds": (positive, 45.0),
    "content_unit_max_duration_seconds": (positive, 240.0),
    "content_unit_min_transcript_chars": (whole, 80),
    "handout_max_images_per_unit": (whole, 1),
    "handout_near_duplicate_image_policy": (text, "keep_one_representative"),
    "handout_prefer_fuller_state": (boolean, True),
    "handout_include_timestamps": (boolean, True),
    "handout_include_generated_notice": (boolean, True),
    "handout_min_image_spacing_seconds": (nonnegative, 45.0),
    "handout_near_duplicate_max_gap_seconds": (positive, 40.0),
    "handout_near_duplicate_max_difference": (nonnegative, 0.20),
    "handout_rapid_burst_window_seconds": (positive, 60.0),
    "handout_rapid_burst_min_frames": (whole, 3),
    "llm_api_style": (text, "none"),
    "llm_base_url": (text, ""),
    "llm_model": (text, ""),
    "llm_api_key_env": (text, ""),
    "llm_temperature": (nonnegative, 0.2),
    "llm_max_input_chars_per_unit": (whole, 6000),
    "llm_max_excerpt_chars_per_item": (whole, 800),
    "llm_max_output_tokens": (whole, 1200),
    "llm_timeout_seconds": (positive, 60.0),
    "llm_max_retries": (count, 0),
    "llm_concurrency": (whole, 1),
    "llm_save_raw_responses": (boolean, False),
    "llm_allow_network_calls": (boolean, False),
    "unsupported_backend_behavior": (text, "fail_closed"),
    "output_language": (text, "zh-CN"),
    "content_map_known_issues": (strings, []),
}


def resolved(settings: dict, kinds: dict[str, tuple[Callable, Any]]) -> dict:
    return {key: kind(settings.get(key), default, key) for key, (kind, default) in kinds.items()}


def preferred_height(settings: dict) -> int:
    """The height wanted of a video, by its present key or else by its older one."""
    older = whole(settings.get("target_video_height"), 1080, "target_video_height") if _blank(settings.get("preferred_video_height")) else None
    return older or whole(settings["preferred_video_height"], None, "preferred_video_height")


def visual(settings: dict, frame_interval: float | None = None, smoke: float | None = None, most_keyframes: int | None = None) -> dict:
    """The options of the visual stages; arguments that are given stand for the settings'."""
    given = {"frame_interval_seconds": frame_interval, "frame_smoke_seconds": smoke, "max_keyframes": most_keyframes}
    found = resolved({**settings, **{key: value for key, value in given.items() if value is not None}}, VISUAL)
    found["smoke_seconds"] = found.pop("frame_smoke_seconds")
    return {**found, "target_video_height": preferred_height(settings)}


def quality_thresholds(options: dict) -> dict:
    """The part of the visual options that judges single frames."""
    names = ("min_frame_variance", "min_sharpness_score", "dark_frame_mean_threshold", "bright_frame_mean_threshold", "solid_frame_variance_threshold")
    return {name: options[name] for name in names}


def requested_region(options: dict) -> dict:
    """The part of the visual options that says which region of a frame is compared."""
    sides = {f"crop_{side}": options[f"comparison_crop_{side}"] for side in ("left", "top", "right", "bottom")}
    return {"mode": options["comparison_region_mode"], "center_crop_percent": options["comparison_center_crop_percent"], **sides}


def acquisition(settings: dict) -> dict:
    """The options of an acquisition, with the format selector that follows from them."""
    found, height = resolved(settings, ACQUISITION), preferred_height(settings)
    if found["resolution_fallback_strategy"] != "best_available":
        raise ValueError("resolution_fallback_strategy must be best_available")

    def pairs(least: int) -> list[str]:
        best = f"bestvideo[height>={least}]"
        return [f"{best}+bestaudio", f"{best}[ext=mp4]+bestaudio[ext=m4a]", f"best[height>={least}]"]

    rest = ["bestvideo+bestaudio", "best"] if found["allow_video_resolution_fallback"] else pairs(found["min_video_height"])
    selector = found["yt_dlp_format"] or "/".join([*pairs(height), *rest])
    return {"preferred_video_height": height, "target_video_height": height, **found, "effective_format_selector": selector}


def transcription(settings: dict, smoke: float | None = None) -> dict:
    given = {} if smoke is None else {"transcription_smoke_seconds": smoke}
    return resolved({**settings, **given}, TRANSCRIPTION)


def content_map(settings: dict) -> dict:
    """The options of a content map; only one image a unit and one way with near-duplicates are known."""
    found = resolved(settings, CONTENT_MAP)
    if found["handout_near_duplicate_image_policy"] != "keep_one_representative":
        raise ValueError("handout_near_duplicate_image_policy must be keep_one_representative")
    if found["handout_max_images_per_unit"] != 1:
        raise ValueError("handout_max_images_per_unit must be 1")
    return found


class UnsupportedBackend(ValueError):
    pass


class MissingKeyVariable(ValueError):
    pass


class NetworkCallsDisabled(ValueError):
    pass


class Backend:
    """What turns a request into a section."""

    name = ""

    def checked(self, options: dict) -> dict:
        raise NotImplementedError

    def section(self, request: dict) -> dict:
        raise NotImplementedError


class SkeletonBackend(Backend):
    """Writes nothing: a skipped section for each request, no network, no key."""

    name = "none"

    def checked(self, options: dict) -> dict:
        if options["content_generation_backend_mode"] != "skeleton":
            raise ValueError("content_generation_backend_mode must be skeleton")
        return {"status": "success", "backend": self.name, "mode": "skeleton", "network_calls": False, "api_key_required": False}

    def section(self, request: dict) -> dict:
        nothing = dict.fromkeys(("section_title", "section_summary", "error"))
        lists = ("key_points", "examples", "cited_transcript_item_ids", "cited_visual_segment_ids", "selected_keyframe_paths", "warnings")
        head = {"status": "skipped", "skip_reason": "backend_none_skeleton_mode", "source_unit_id": request["unit_id"]}
        return {**head, **nothing, **{name: [] for name in lists}, "model_metadata": {}, "usage": {}}


BACKENDS: dict[str, type[Backend]] = {"none": SkeletonBackend}


def backend(options: dict) -> Backend:
    """The backend that the options name, checked; fails closed for any that is not known."""
    name = options["content_generation_backend"]
    if options["llm_allow_network_calls"]:
        raise NetworkCallsDisabled("no network calls are made")
    if name not in BACKENDS:
        if not options["llm_api_key_env"]:
            raise MissingKeyVariable("llm_api_key_env must name an environment variable")
        raise UnsupportedBackend(f"no backend {name!r}")
    found = BACKENDS[name]()
    found.checked(options)
    return found
