"""Parameters of the stages, from defaults or an INI file, checked for real."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Import:
    merge_columns: tuple[str, ...] = ("title", "abstract")
    order: tuple[str, ...] = ("src_file", "_row")
    target: str = "text"


@dataclass(frozen=True)
class Parse:
    functions: tuple[str, ...] = ("unidecoder", "dedash", "titlecaps", "replace_acronyms", "separated_parenthesis", "replace_from_dictionary", "token_replacement", "decaps_text", "pos_tokenizer")
    min_keep_length: int = 10
    acronym_prefix: str = ""
    acronym_suffix: str = "ABBR"
    dictionary: str = ""  # a CSV file with columns phrase and term
    dictionary_prefix: str = ""
    dictionary_suffix: str = "_MeSH"
    pos_blacklist: tuple[str, ...] = ("pronoun", "verb", "adjective", "punctuation", "possessive", "symbol", "cardinal", "connector", "adverb", "unknown")


@dataclass(frozen=True)
class Embed:
    size: int = 300
    window: int = 5
    min_count: int = 10
    epochs: int = 30
    skip_gram: int = 0
    hierarchical_softmax: int = 1
    negative: int = 0
    sample: float = 1e-5
    seed: int = 0
    partitions: int = 0  # 0: as many as there are cores


@dataclass(frozen=True)
class Score:
    methods: tuple[str, ...] = ("unique_IDF",)
    downsample_weights: dict[str, float] = field(default_factory=dict)
    reduced: bool = False
    components: int = 25


@dataclass(frozen=True)
class Metacluster:
    method: str = "unique_IDF"
    m: int = 2000
    kn: int = 25
    pcut: float = 0.8
    repeats: int = 1
    seed: int = 0


@dataclass(frozen=True)
class Analyze:
    compute_dispersion: bool = False
    topn: int = 10
    master_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Explain:
    closeness: float = 0.6
    texts: int = 25
    samples: int = 25
    features: int = 50
    trees: int = 50
    seed: int = 0


@dataclass(frozen=True)
class Predict:
    column: str = "label"
    methods: tuple[str, ...] = ("unique_IDF",)
    folds: int = 10
    trees: int = 200
    use_smote: bool = False
    use_meta: bool = False
    extra_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    import_data: Import = Import()
    parse: Parse = Parse()
    embed: Embed = Embed()
    score: Score = field(default_factory=Score)
    metacluster: Metacluster = Metacluster()
    analyze: Analyze = Analyze()
    explain: Explain = Explain()
    predict: Predict = Predict()


def _cast(text: str, default: Any, where: str) -> Any:
    try:
        if isinstance(default, bool):
            return {"true": True, "false": False, "1": True, "0": False, "yes": True, "no": False}[text.strip().lower()]
        if isinstance(default, dict):
            return {k.strip(): float(v) for k, v in (x.split(":") for x in text.split(",") if x.strip())}
        if isinstance(default, tuple):
            return tuple(x.strip() for x in text.split(",") if x.strip())
        return type(default)(text.strip())
    except (KeyError, ValueError) as e:
        raise ValueError(f"{where}: {text!r} is no {type(default).__name__}") from e


def load_config(path: str) -> Config:
    """The configuration of an INI file; FileNotFoundError without it, ValueError for unknown sections, options or values
    of a wrong kind. What it leaves out has its default."""
    parser = configparser.ConfigParser(interpolation=None)
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    config = Config()
    known = {f.name for f in fields(Config)}
    for name in parser.sections():
        if name not in known:
            raise ValueError(f"unknown section {name}; there are {sorted(known)}")
        stage = getattr(config, name)
        options = {f.name for f in fields(stage)}
        for key, text in parser[name].items():
            if key not in options:
                raise ValueError(f"unknown option {name}.{key}; there are {sorted(options)}")
            stage = replace(stage, **{key: _cast(text, getattr(stage, key), f"{name}.{key}")})
        config = replace(config, **{name: stage})
    return config
