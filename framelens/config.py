"""Configuration files (YAML or JSON): found by name, checked, merged with updates, saved. Driver side only."""

from __future__ import annotations

import json
import logging
import sys
from copy import deepcopy
from pathlib import Path
from typing import Any

from framelens import lexicons as L

log = logging.getLogger(__name__)

ENDINGS = (".yaml", ".yml", ".json")
PATH_KEYS = ("data_dir", "articles_file", "sample_articles", "processed_data", "cache_dir", "models_dir", "results_dir", "logs_dir")
SECTIONS = {"data_config": ("loading", "splitting", "human_coding", "metadata"), "model_config": ("zero_shot", "fine_tuning", "preprocessing")}


def read_config(path: str | Path) -> dict[str, Any]:
    """A config file by its ending."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"config file not found: {path}")
    if path.suffix not in ENDINGS:
        raise ValueError(f"unsupported config format: {path.suffix}")
    with path.open(encoding="utf-8") as f:
        if path.suffix == ".json":
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def merged(base: dict[str, Any], updates: dict[str, Any]) -> dict[str, Any]:
    """base with updates, nested dicts merged key by key; neither is changed."""
    out = deepcopy(base)
    for k, v in updates.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


class ConfigManager:
    def __init__(self, folder: str | Path = "configs", environment: str | None = None):
        self.folder = Path(folder)
        self.environment = environment or ("colab" if "google.colab" in sys.modules else "local")
        self._loaded: dict[str, dict[str, Any]] = {}

    def load(self, name: str, validate: bool = True) -> dict[str, Any]:
        if name not in self._loaded:
            path = next((p for e in ENDINGS if (p := self.folder / f"{name}{e}").exists()), None)
            if path is None:
                raise FileNotFoundError(f"config file not found: {name}")
            config = self._for_environment(read_config(path))
            if validate:
                self.check(name, config)
            self._loaded[name] = config
        return self._loaded[name]

    def _for_environment(self, config: dict[str, Any]) -> dict[str, Any]:
        """Where a config has a section for each environment, the present one's entries are put at the top."""
        if "local" in config and "colab" in config:
            return config | (config.get(self.environment) or {})
        return config

    def check(self, name: str, config: dict[str, Any]) -> None:
        for section in SECTIONS.get(name, ()):
            if section not in config:
                raise ValueError(f"missing section in {name}: {section}")
        if name == "data_config":
            s = config["splitting"]
            total = s["train_ratio"] + s["val_ratio"] + s["test_ratio"]
            if abs(total - 1.0) > 1e-6:
                raise ValueError(f"split ratios must sum to 1, not {total}")
            if set(config["human_coding"]["frame_types"]) != set(L.FRAMES):
                log.warning("frame types other than %s", L.FRAMES)
        elif name == "model_config":
            tuning = config["fine_tuning"]
            if not 1e-6 <= tuning["learning_rate"] <= 1e-2:
                log.warning("unusual learning rate %s", tuning["learning_rate"])
            if not 0 < tuning["batch_size"] <= 128:
                log.warning("unusual batch size %s", tuning["batch_size"])
        elif name == "frame_definitions":
            for frame in L.FRAMES:
                for key in ("definition", "keywords"):
                    if key not in (config.get("frames") or {}).get(frame, {}):
                        raise ValueError(f"missing {key} of frame {frame}")

    def paths(self) -> dict[str, Path]:
        config = self.load("data_config")
        return {k: Path(config[k]) for k in PATH_KEYS if k in config}

    def frame_definitions(self) -> dict[str, Any]:
        return self.load("frame_definitions")

    def lexicons(self) -> dict[str, dict[str, tuple[str, ...]]]:
        """The lexicons as the definitions file has them, in the form of ``lexicons.FRAME_LEXICONS``."""
        return {f: {c: tuple(terms) for c, terms in d["keywords"].items()} for f, d in self.frame_definitions()["frames"].items()}

    def model_params(self, kind: str = "zero_shot") -> dict[str, Any]:
        config = self.load("model_config")
        if kind not in config:
            raise ValueError(f"unknown model type: {kind}")
        return config[kind]

    def create_directories(self) -> None:
        for k, p in self.paths().items():
            if k.endswith("_dir"):
                p.mkdir(parents=True, exist_ok=True)

    def update(self, name: str, updates: dict[str, Any]) -> None:
        self._loaded[name] = merged(self.load(name), updates)

    def save(self, name: str, path: str | Path | None = None) -> None:
        if name not in self._loaded:
            raise ValueError(f"config not loaded: {name}")
        import yaml

        with Path(path or self.folder / f"{name}.yaml").open("w", encoding="utf-8") as f:
            yaml.safe_dump(self._loaded[name], f, indent=2, allow_unicode=True)


_manager: ConfigManager | None = None


def get_config_manager(folder: str | Path = "configs") -> ConfigManager:
    global _manager
    if _manager is None:
        _manager = ConfigManager(folder)
    return _manager


def load_config(name: str) -> dict[str, Any]:
    return get_config_manager().load(name)


def get_paths() -> dict[str, Path]:
    return get_config_manager().paths()


def setup_environment() -> None:
    """Makes the configured directories and sets up logging at the configured level."""
    from framelens.report import setup_logging

    m = get_config_manager()
    m.create_directories()
    setup_logging((m.load("data_config").get("logging") or {}).get("level", "INFO"))
