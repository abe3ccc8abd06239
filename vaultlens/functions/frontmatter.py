"""YAML frontmatter as JSON, by an Arrow UDF; bad YAML and what is no mapping become {}."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def yaml_to_json(text: str | None) -> str | None:
    if text is None:
        return None
    import yaml

    try:
        loaded = yaml.safe_load(text)
    except yaml.YAMLError:
        loaded = None
    return json.dumps(loaded if isinstance(loaded, dict) else {}, default=str, ensure_ascii=False)


@F.pandas_udf(StringType())
def yaml_json(text: pd.Series) -> pd.Series:
    return text.map(yaml_to_json)
