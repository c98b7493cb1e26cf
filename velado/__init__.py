"""velado: Spark-native de-identification of clinical text tables.

Subpackages: ``functions`` (Column expressions: patterns, spans, text, structured, tokens),
``operators`` (DataFrame jobs: masking, detection, corpus, features, ML, evaluation),
``sources`` (readers and sinks), ``plans`` (registered queries and their SQL oracles),
``streaming`` (the same masking on ``readStream``).
"""

from .profile import Profile, default_profile, load_profile, normalize_profile  # noqa: F401

__version__ = "0.1.0"
