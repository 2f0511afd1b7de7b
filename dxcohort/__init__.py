"""dxcohort: diagnosis-code cohort queries over insurance claims on Spark.

Inputs are DataFrames of admissions (a ranked array of diagnosis codes),
beneficiaries and yearly enrollments. Everything is built from Spark's own
DataFrame operators; nothing is collected on the driver except bounded code
lists.

* ``dxcohort.functions`` - column expressions (ages, positions, membership, flags)
* ``dxcohort.operators`` - joins, bands, explode/count/top-k, first row per
  person, running count, skew-safe joins, code-list expansion, blanking
* ``dxcohort.plans``     - the composite queries (counts, zip shares,
  individual extract, export) and the named-query catalog
* ``dxcohort.sources``   - schemas, readers/writers, code lists, test fixture
* ``dxcohort.streaming`` - notes on streaming use (the source has no streams)
"""

__version__ = "0.1.0"
