"""Every registered query and its check, by module."""

from .base import ORACLE, QUERIES
from . import bars as _bars  # noqa: F401
from . import features as _features  # noqa: F401
from . import audits as _audits  # noqa: F401
from . import labels as _labels  # noqa: F401
from . import scores as _scores  # noqa: F401
from . import signals as _signals  # noqa: F401
from . import portfolio as _portfolio  # noqa: F401
from . import models as _models  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
