"""Training parameters, and the key=value configuration file."""

from __future__ import annotations

import dataclasses
import warnings

#: Configuration keys and the field each one sets.
ALIASES = {
    "n_parties": "n_parties", "num_parties": "n_parties", "n_clients": "n_parties", "num_clients": "n_parties", "n_devices": "n_parties", "num_devices": "n_parties",
    "mode": "mode", "fl_mode": "mode", "partition": "partition", "merge_histogram": "merge_histogram",
    "privacy": "privacy", "privacy_tech": "privacy", "privacy_method": "privacy", "security_tech": "privacy", "privacy_budget": "privacy_budget",
    "propose_split": "propose_split", "key_length": "key_length",
    "data": "data", "test_data": "test_data", "model_path": "model_path", "pred_output": "pred_output",
    "max_depth": "depth", "depth": "depth", "num_round": "n_trees", "n_trees": "n_trees", "max_num_bin": "max_bins", "max_bin": "max_bins", "bins": "max_bins",
    "learning_rate": "learning_rate", "eta": "learning_rate", "reg_lambda": "reg_lambda", "lambda": "reg_lambda", "gamma": "gamma", "min_child_weight": "min_child_weight",
    "objective": "objective", "num_class": "num_class", "constant_h": "constant_h", "metric": "metric",
    "bagging": "bagging", "ins_bagging_fraction": "bagging_fraction", "reorder_label": "reorder_label", "n_features": "n_features", "seed": "seed",
}


#: Other names of the proposals; keys that are known and have no effect here, of which parse_config warns.
PROPOSALS = {"client": "party", "client_pre": "party"}
WITHOUT_EFFECT = ("partition_mode", "alpha", "n_hori", "n_verti", "variance", "verbose", "colsample", "colsample_bytree", "column_sampling_rate", "n_device", "n_gpus", "ip_address", "num_parallel_trees")


@dataclasses.dataclass(frozen=True)
class Params:
    """All settings of training; see README for those that only choose a mode."""

    mode: str = "horizontal"  # horizontal, vertical, hybrid, ensemble, centralized, solo
    n_parties: int = 2
    partition: bool = False
    privacy: str = "none"  # none, dp, sa, he
    privacy_budget: float = 10.0
    propose_split: str = "server"  # server: range cuts; party: distinct-value cuts, pooled; client_post: those, and histograms over each party's range cuts, moved when merged; sketch: quantiles of merged sketches, in any mode
    key_length: int = 512
    data: str = ""
    test_data: str = ""
    model_path: str = "model"
    pred_output: str = ""
    depth: int = 6
    n_trees: int = 40
    max_bins: int = 32
    learning_rate: float = 1.0
    reg_lambda: float = 1.0
    gamma: float = 1.0
    min_child_weight: float = 1.0
    objective: str = "reg:linear"
    num_class: int = 1
    constant_h: float = 0.0
    metric: str = ""
    bagging: bool = False
    bagging_fraction: float = 1.0
    reorder_label: bool = False
    n_features: int = 0
    seed: int = 42

    def __post_init__(self):
        if not 0 < self.max_bins <= 255:
            raise ValueError("max_bins must be from 1 to 255")
        if self.depth < 1 or self.n_trees < 1:
            raise ValueError("depth and n_trees must be positive")
        if self.propose_split not in ("server", "party", "client_post", "sketch"):
            raise ValueError("propose_split is server, party, client_post or sketch")
        if self.propose_split == "client_post" and self.privacy in ("sa", "he"):
            raise ValueError("histograms over parties' own cuts can't be merged under masks or encryption")
        if not 0 < self.bagging_fraction <= 1:
            raise ValueError("bagging_fraction must be in (0, 1]")
        if self.privacy == "dp" and not self.constant_h:
            object.__setattr__(self, "constant_h", 1.0)  # the sensitivity bound needs a fixed hessian

    @property
    def classes(self) -> int:
        """Trees of a round: one for each class beyond two."""
        return self.num_class if self.objective.startswith("multi:") else 1

    def replace(self, **changes) -> Params:
        return dataclasses.replace(self, **changes)


def _cast(kind: str, text: str):
    if kind == "bool":
        return text.strip().lower() not in ("0", "false", "no", "")
    return {"int": lambda t: int(float(t)), "float": float, "str": str.strip}[kind](text)


def parse_config(text: str, **overrides) -> Params:
    """Params from lines key=value; `#` starts a comment, unknown keys are refused, known ones without effect give a warning."""
    kinds = {f.name: f.type for f in dataclasses.fields(Params)}
    values: dict = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        key, sign, value = line.partition("=")
        if sign and key.strip() in WITHOUT_EFFECT:
            warnings.warn(f"{key.strip()} has no effect", stacklevel=2)
            continue
        if not sign or key.strip() not in ALIASES:
            raise ValueError(f"line {number}: {line!r} is not a known key=value setting")
        field = ALIASES[key.strip()]
        if field == "propose_split":
            value = PROPOSALS.get(value.strip(), value)
        if field == "merge_histogram":  # by parties' own cuts, or by common ones as the proposal says
            if value.strip() == "client":
                values["propose_split"] = "client_post"
            continue
        values[field] = _cast(kinds[field], value)
    return Params(**(values | overrides))
