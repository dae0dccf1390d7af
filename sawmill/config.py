"""Settings of the analyses: defaults, YAML files merged over them, dotted overrides."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# Defaults, patterns and rule texts that results depend on.
DEFAULTS: dict[str, Any] = {
    "drain": {"depth": 4, "st": 0.4, "max_child": 100, "sim_th": 0.4},
    "correlate": {"window_size": 60, "min_support": 0.01, "min_confidence": 0.5, "min_lift": 2.0, "burst_threshold": 100, "min_count": 10},
    "preprocess": {
        "patterns": [
            {"name": "IP", "regex": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"},
            {"name": "UUID", "regex": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"},
            {"name": "PATH", "regex": r"(?:/[\w\-.~]+)+\.?(?:[\w\-]+)?"},
            {"name": "NUM", "regex": r"\b\d+\b"},
            {"name": "EMAIL", "regex": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"},
        ],
        "order": ["IP", "UUID", "PATH", "NUM", "EMAIL"],
    },
    "input": {"format": "auto", "time_format": "", "custom_regex": "", "timestamp_group": "timestamp", "level_group": "level", "source_group": "source", "message_group": "message"},
    "anomaly": {"baseline_file": "", "freq_unit": "hour", "freq_n_std": 3.0, "freq_m_periods": 3, "min_data_points": 24},
    "clustering": {"merge_threshold": 0.3},
    "filters": {"whitelist": [], "focus": []},
    "output": {"format": "terminal", "output_dir": "./output", "top_n": 20, "html_max_templates": 50},
    "incremental": {"state_file": "./sawmill-state.json", "max_templates": 10000, "rare_template_count": 5},
    "parallel": {"workers": 0},
    "alerts": [
        {"name": "high_error_templates", "condition": "error_template_count > 5", "severity": "critical", "message": "检测到 {error_template_count} 个ERROR模板，超过阈值5"},
        {"name": "spike_surge", "condition": "spike_count > 10", "severity": "warning", "message": "频率激增模板 {spike_count} 个，超过阈值10"},
        {"name": "slow_processing", "condition": "processing_speed < 50000", "severity": "info", "message": "处理速度 {processing_speed:.0f} 行/秒，低于5万行/秒"},
    ],
    "tags": [
        {"pattern": r"(?i)(error|exception|fail|fatal)", "tags": ["error/general"]},
        {"pattern": r"(?i)(timeout|timed.?out)", "tags": ["infra/network/timeout"]},
        {"pattern": r"(?i)(database|mysql|postgres|sql|connection.*refused)", "tags": ["infra/database/connection"]},
        {"pattern": r"(?i)(out.?of.?memory|oom|heap)", "tags": ["infra/resource/memory"]},
    ],
}
CONFIG_FILE = "sawmill.yaml"


class Section(dict):
    """A section whose keys are attributes too."""

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None


@dataclass
class Settings:
    """All sections; ``alerts`` and ``tags`` are lists of plain dicts."""

    values: dict[str, Any] = field(default_factory=lambda: copy.deepcopy(DEFAULTS))

    def __getattr__(self, name: str) -> Any:
        if name == "values":
            raise AttributeError(name)
        found = self.values.get(name)
        if found is None:
            raise AttributeError(name)
        return Section(found) if isinstance(found, dict) else found


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``: sections merge key by key, lists and scalars are replaced."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def load_settings(path: str | None = None) -> Settings:
    file = Path(path or CONFIG_FILE)
    if not file.exists():
        return Settings()
    import yaml

    return Settings(merged(copy.deepcopy(DEFAULTS), yaml.safe_load(file.read_text("utf-8")) or {}))


def overridden(settings: Settings, overrides: dict[str, Any]) -> Settings:
    """Dotted keys set to their values; None leaves a value alone."""
    values = copy.deepcopy(settings.values)
    for dotted, value in overrides.items():
        if value is None:
            continue
        *path, last = dotted.split(".")
        at = values
        for name in path:
            at = at.setdefault(name, {})
        at[last] = value
    return Settings(values)


def write_sample(path: str = CONFIG_FILE) -> str:
    import yaml

    Path(path).write_text(yaml.safe_dump(DEFAULTS, allow_unicode=True, sort_keys=False), "utf-8")
    return path
