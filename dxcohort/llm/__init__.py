"""Operators for preparing language-model training data.

One module per operator; ``queries`` registers the ``opN_*`` queries and
``oracles`` their DuckDB SQL. Nothing else in the library imports this package.

Common conventions, kept by every operator and pipeline stage:

* a null text is an empty text, unless the operator's docstring says otherwise;
* ``doc_id`` may be null or repeated; each row stays a document of its own, but in the
  classes of operator 4, whose links are between identifiers (its pipeline stage judges
  every text by itself);
* columns that an operator does not know pass through or are ignored, whatever
  their names: operators read only the columns they name, and where a caller's columns
  pass through, working columns take names that none of them has;
* texts of any length are read whole; a task holds its longest text;
* ties are broken as the operator's docstring says, so results do not depend on
  partitions;
* an empty table gives an empty result of the same schema;
* written intermediate tables go to the shared checkpoint folder and are removed where
  no later step or result reads them.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
