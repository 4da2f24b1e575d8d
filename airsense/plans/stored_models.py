"""Three small fitted models as documents (``model_sql.describe``), to score the given readings with.

They were fitted on the readings of one table with few inputs: a classifier chain, a forest and
extra-trees of three trees and three levels. Their numbers are fixed, so probabilities, alerts and
summaries of a fitted model can be compared with another engine's.
"""

import json
from pathlib import Path

STORED_MODELS: dict[str, dict] = json.loads(Path(__file__).with_name("stored_models.json").read_text())
