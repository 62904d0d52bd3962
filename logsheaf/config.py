"""Fixed values of the data model, and the parameters of each job."""

from __future__ import annotations

from dataclasses import dataclass

SECONDS_PER_DAY = 86_400

# The columns of an authentication record, in wire order.
AUTH_COLUMNS_9 = (
    "time",
    "src_user",
    "dst_user",
    "src_computer",
    "dst_computer",
    "auth_type",
    "logon_type",
    "auth_orientation",
    "success",
)
AUTH_COLUMNS_7 = (
    "time",
    "src_user",
    "src_computer",
    "dst_computer",
    "auth_type",
    "logon_type",
    "success",
)

# Texts that mean success, after strip and lower.
SUCCESS_VALUES = ("success", "1", "true", "t", "yes")

# Identity candidates in order of preference.
USER_CANDIDATES = ("user", "src_user", "source_user", "username")
HOST_CANDIDATES = ("host", "src_computer", "src_host", "source_host")

# Names that never reach stored sessions.
SENSITIVE_FIELDS = (
    "user",
    "host",
    "username",
    "source_user",
    "source_host",
    "src_user",
    "dst_user",
    "src_host",
    "src_computer",
    "dst_computer",
    "template_params",
)

# Special tokens, in id order.
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[MASK]", "[PAD]", "[UNK]")

# Event ids that stand for "no id".
PLACEHOLDER_EVENT_IDS = ("", "NA", "UNK")

# Inclusive day ranges of the time splits.
SPLIT_DAYS = {
    "train": (1, 40),
    "val": (41, 50),
    "test": (51, 58),
    "all": (1, 58),
}
# The declared training settings name other ranges.
TRAINING_SPLIT_DAYS = {
    "pretrain": (1, 50),
    "finetune": (51, 55),
    "test": (56, 58),
}

# Message masks, applied in this order.
MESSAGE_MASKS = (
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("HASH", r"\b[a-fA-F0-9]{32,64}\b"),
    ("TIMESTAMP", r"\b(?:19|20)\d{2}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}\b"),
    ("USER", r"\buser=\w+\b"),
)
# A text that every match of a mask holds, which is quick to look for.
MASK_NEEDLES = {"IP": ".", "EMAIL": "@", "TIMESTAMP": ":", "USER": "user="}
WILDCARD = "<*>"

# Template mining settings.
DRAIN_SIMILARITY = 0.4
DRAIN_CHILDREN = 100

# Declared scoring settings.
RECONSTRUCTION_WEIGHT = 0.6
EMBEDDING_WEIGHT = 0.4
ANOMALY_THRESHOLD = 0.75
SEVERITY_BANDS = (("critical", 0.90), ("high", 0.75), ("medium", 0.50), ("low", 0.0))
RISK_DECAY = 0.95
RISK_ANOMALY_WEIGHT = 0.05
ALERT_ANOMALY_WEIGHT = 0.5
ALERT_USER_RISK_WEIGHT = 0.3
ALERT_TECHNIQUE_WEIGHT = 0.2
TECHNIQUE_BONUS = {
    "T1486": 0.4,
    "T1490": 0.4,
    "T1003": 0.3,
    "T1053": 0.2,
    "T1543": 0.2,
    "T1018": 0.1,
    "T1083": 0.1,
}
ALERT_PERCENTILES = {"P1": 99.9, "P2": 99.0, "P3": 97.0}

# Declared masked-token settings.
MASK_PROBABILITY = 0.15
MASK_TOKEN_SHARE = 0.80
MASK_RANDOM_SHARE = 0.10

# Largest id that fits each stored token id type.
TOKEN_ID_LIMITS = {
    "uint8": 255,
    "int16": 32_767,
    "int32": 2_147_483_647,
    "int64": 9_223_372_036_854_775_807,
}
TOKEN_ID_SPARK_TYPES = {"int16": "smallint", "int32": "int", "int64": "bigint"}


@dataclass(frozen=True)
class SessionConfig:
    """Sliding-window session parameters.

    With ``merge_similar`` the sessions job gives similar messages one template,
    within a tree of ``prefix_tokens`` levels of at most ``max_children`` children.

    ``hot_group_rows`` and ``max_hot_groups`` only choose the physical route
    of large groups (see ``operators.sessions``); they never change results.
    """

    window_mins: int = 30
    stride_mins: int = 15
    min_events: int = 3
    max_tokens: int = 512
    timestamp_unit: str = "seconds"
    id_hex_chars: int = 8
    hot_group_rows: int | None = 1_000_000
    max_hot_groups: int = 100_000
    merge_similar: bool = False
    similarity: float = DRAIN_SIMILARITY
    prefix_tokens: int = 1
    max_children: int = DRAIN_CHILDREN

    def __post_init__(self) -> None:
        for name in ("window_mins", "stride_mins", "min_events", "max_tokens"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name}: a positive number is needed, not {getattr(self, name)}")
        if self.timestamp_unit not in ("seconds", "milliseconds"):
            raise ValueError(f"unknown timestamp_unit {self.timestamp_unit!r}: seconds or milliseconds")
        if not 1 <= self.id_hex_chars <= 64:
            raise ValueError("id_hex_chars must be between 1 and 64")
        if self.hot_group_rows is not None and self.hot_group_rows <= 0:
            raise ValueError("hot_group_rows must be > 0, or None to turn the check off")
        if not 0 < self.similarity <= 1:
            raise ValueError("similarity must be above 0 and at most 1")
        if self.prefix_tokens < 0 or self.max_children < 1:
            raise ValueError("prefix_tokens must be >= 0 and max_children >= 1")
        if self.max_hot_groups <= 0:
            raise ValueError("max_hot_groups must be > 0")

    @property
    def units_per_second(self) -> int:
        return 1 if self.timestamp_unit == "seconds" else 1_000

    @property
    def window_units(self) -> int:
        return self.window_mins * 60 * self.units_per_second

    @property
    def stride_units(self) -> int:
        return self.stride_mins * 60 * self.units_per_second

    @property
    def day_units(self) -> int:
        return SECONDS_PER_DAY * self.units_per_second


@dataclass(frozen=True)
class TokenConfig:
    """Vocabulary and token sequence parameters."""

    min_freq: int = 5
    max_len: int = 512
    truncation_side: str = "left"
    chunk_size: int = 10_000
    token_id_dtype: str = "int32"

    def __post_init__(self) -> None:
        if self.min_freq <= 0:
            raise ValueError(f"min_freq: a positive number is needed, not {self.min_freq}")
        if self.max_len < 3:
            raise ValueError("max_len must be >= 3 to hold [CLS], one token and [SEP]")
        if self.truncation_side not in ("left", "right"):
            raise ValueError(f"unknown truncation_side {self.truncation_side!r}: left or right")
        if self.chunk_size <= 0:
            raise ValueError(f"chunk_size: a positive number is needed, not {self.chunk_size}")
        if self.token_id_dtype not in TOKEN_ID_SPARK_TYPES:
            raise ValueError(f"no column type for token_id_dtype {self.token_id_dtype!r}")


# The declared session length limits of model training.
TRAINING_SESSIONS = SessionConfig(min_events=3, max_tokens=500)
