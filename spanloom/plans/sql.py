"""DuckDB SQL of all registered queries that have some."""

from .agreement_sql import AGREEMENT_SQL
from .blocks_sql import BLOCKS_SQL
from .jackknife_sql import JACKKNIFE_SQL
from .model_sql import MODEL_SQL
from .oracles import ORACLE_SQL
from .study_sql import STUDY_SQL

ALL_SQL: dict[str, str] = ORACLE_SQL | STUDY_SQL | MODEL_SQL | JACKKNIFE_SQL | AGREEMENT_SQL | BLOCKS_SQL
