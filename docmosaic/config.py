"""Configuration: dataclasses read from YAML, with the defaults in force."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from docmosaic.operators.chunking import ChunkSettings
from docmosaic.plans.retrieval import QuerySettings


@dataclass(frozen=True)
class StoreSettings:
    """Where chunks and the file ledger live: Spark tables."""

    chunks_table: str = "chunks"
    ledger_table: str = "file_hashes"
    output_dir: str = "output"


@dataclass(frozen=True)
class ModelSettings:
    """Names passed to the injected embedder and language model."""

    embedding_model: str = "hashed_words"
    language_model: str = "extractive"
    num_predict: int = 1500
    context_window: int = 32768


@dataclass(frozen=True)
class Config:
    store: StoreSettings = field(default_factory=StoreSettings)
    models: ModelSettings = field(default_factory=ModelSettings)
    chunking: ChunkSettings = field(default_factory=ChunkSettings)
    query: QuerySettings = field(default_factory=QuerySettings)

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        """Unknown keys are ignored; a relative output folder is kept relative to the working folder."""
        parts = {}
        for f in fields(cls):
            kind = f.default_factory
            known = {x.name for x in fields(kind)}
            parts[f.name] = kind(**{k: v for k, v in (data.get(f.name) or {}).items() if k in known})
        return cls(**parts)

    @classmethod
    def from_yaml(cls, path: str | Path) -> Config:
        """Settings of a YAML file; its output folder is resolved against the file's place."""
        data = load_yaml(path)
        store = dict(data.get("store") or {})
        out = store.get("output_dir")
        if out and not Path(out).is_absolute() and "://" not in out:
            store["output_dir"] = str((Path(path).resolve().parent / out).resolve())
        return cls.from_dict({**data, "store": store})

    def to_dict(self) -> dict:
        return asdict(self)


def load_yaml(path: str | Path) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_batch(path: str | Path) -> list[str] | None:
    """Config paths of a batch file (its file_paths are YAML files), or None for a plain config."""
    paths = load_yaml(path).get("file_paths") or []
    if not paths or not str(paths[0]).endswith((".yaml", ".yml")):
        return None
    base = Path(path).resolve().parent
    return [str(p if Path(p).is_absolute() else base / p) for p in paths]


def sidecar(source: str, suffix: str) -> str:
    """``<folder>/<stem><suffix>`` next to a source file."""
    p = Path(source)
    return str(p.with_name(p.stem + suffix))


def load_aliases(spark, path: str | Path):
    """(canonical, alias) rows of an alias map; keys and aliases in lower case."""
    rows = [(str(k).lower(), str(a).lower()) for k, v in load_yaml(path).items() for a in v or []]
    return spark.createDataFrame(rows, "canonical string, alias string")


def list_configs(folder: str | Path, hide: str = "todo_") -> list[str]:
    """Names of the YAML files of a folder, planned ones left out."""
    return sorted(p.stem for p in Path(folder).glob("*.y*ml") if not p.name.startswith(hide))
