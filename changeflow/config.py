"""Settings of the engine and of a topic, validated when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

REPLICATION, HISTORY = "replication", "history"
#: Converters of message keys.
STRING_KEYS = "org.apache.kafka.connect.storage.StringConverter"
JSON_KEYS = "org.apache.kafka.connect.json.JsonConverter"
FREQUENCIES = ("monthly", "daily", "hourly")


@dataclass(frozen=True)
class SoftPartitions:
    column: str
    frequency: str
    max_partitions: int

    def __post_init__(self) -> None:
        if self.frequency not in FREQUENCIES or not self.column or self.max_partitions <= 0:
            raise ValueError("soft partitions need a frequency, a column and a positive number of partitions")


@dataclass(frozen=True)
class TopicConfig:
    topic: str
    schema: str
    database: str = ""
    table: str = ""  # empty: the name that each message carries
    format: str = "relational"  # relational, document, tracking
    key_format: str = JSON_KEYS
    reference: str = ""
    soft_delete: bool = False
    append_only: bool = False
    drop_deleted_columns: bool = False
    skip_operations: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    hash: tuple[str, ...] = ()
    hash_salt: str = ""
    encrypt: tuple[str, ...] = ()
    encrypt_json: bool = False
    static: tuple[tuple[str, str], ...] = ()
    keys_override: tuple[str, ...] = ()
    keys_include: tuple[str, ...] = ()
    updated_at: bool = False
    db_updated_at: bool = False
    operation: bool = False
    source_metadata: bool = False
    full_table_name: bool = False
    merge_predicates: tuple[str, ...] = ()
    soft_partitions: SoftPartitions | None = None
    multi_step_flushes: int | None = None

    def __post_init__(self) -> None:
        if not (self.topic and self.schema and self.format):
            raise ValueError("topic, schema and format are required")
        if self.key_format not in (STRING_KEYS, JSON_KEYS):
            raise ValueError(f"unknown key format {self.key_format!r}")
        if self.include and self.exclude:
            raise ValueError("columns can be included or excluded, not both")
        if self.keys_override and self.keys_include:
            raise ValueError("keys can be overridden or added to, not both")
        both = {*self.encrypt} & {*self.keys_override, *self.keys_include}
        if both:
            raise ValueError(f"key columns can't be encrypted: {sorted(both)}")
        if self.multi_step_flushes is not None and self.multi_step_flushes <= 0:
            raise ValueError("a multi-step merge needs a positive number of flushes")

    def skipped(self) -> set[str]:
        """Operations to leave out: a comma-separated list, case and blanks aside."""
        return {s.strip().lower() for s in self.skip_operations.split(",") if s.strip()}


@dataclass(frozen=True)
class EngineConfig:
    topics: tuple[TopicConfig, ...]
    mode: str = REPLICATION
    prefix: str = "__cf_"
    flush_seconds: int = 10
    buffer_rows: int = 30_000
    flush_kb: int = 25 * 1024
    passphrase: str = ""
    key_service: str = ""
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in (REPLICATION, HISTORY):
            raise ValueError(f"unknown mode {self.mode!r}")
        if not 5 <= self.flush_seconds <= 6 * 60 * 60:
            raise ValueError("the flush interval lies between 5 seconds and 6 hours")
        if self.buffer_rows < 1 or self.flush_kb < 1:
            raise ValueError("buffers must be positive")
        if not self.topics:
            raise ValueError("there is no topic")
        refs = [t.reference for t in self.topics if t.reference]
        if len(refs) != len(set(refs)):
            raise ValueError("two topics have the same reference")
        if self.mode == HISTORY:
            for t in self.topics:
                if t.drop_deleted_columns or t.soft_partitions:
                    raise ValueError("history keeps columns and has no soft partitions")
                if not t.db_updated_at:
                    raise ValueError("history needs the database's update time")
        if any(t.encrypt or t.encrypt_json for t in self.topics) and bool(self.passphrase) == bool(self.key_service):
            raise ValueError("encryption needs either a passphrase or a key service")


_TUPLES = {"include", "exclude", "hash", "encrypt", "keys_override", "keys_include", "merge_predicates"}


def from_dict(data: dict) -> EngineConfig:
    """Settings from plain values, as a YAML or JSON file holds them; a name that isn't a setting is an error."""

    def topic(t: dict) -> TopicConfig:
        t = {k: tuple(v) if k in _TUPLES else tuple(v.items()) if k == "static" and isinstance(v, dict) else v for k, v in t.items()}
        if isinstance(t.get("soft_partitions"), dict):
            t["soft_partitions"] = SoftPartitions(**t["soft_partitions"])
        return TopicConfig(**t)

    try:
        return EngineConfig(**{**data, "topics": tuple(topic(t) for t in data.get("topics", ()))})
    except TypeError as e:
        raise ValueError(f"unknown setting: {e}") from None


def from_text(text: str) -> EngineConfig:
    """Settings from JSON text or, where the library for it is installed, YAML."""
    import json

    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("these settings are no JSON, and there is no YAML library") from None
        data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError("settings are an object")
    return from_dict(data)
