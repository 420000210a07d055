"""tessera: language-model data and evaluation jobs as Spark DataFrame plans.

Every public operator is a plain function ``DataFrame -> DataFrame`` or
``Column -> Column`` built from native Spark expressions; Arrow (pandas)
functions are used only where sequential state or user code demands them.
"""

from tessera.session import build_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
