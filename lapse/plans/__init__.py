"""Named queries over the driver test tables (see ``registry``)."""

from lapse.plans import q_analytics  # noqa: F401
from lapse.plans.registry import REGISTRY  # noqa: F401
from lapse.plans import q_prep  # noqa: F401,E402
from lapse.plans import q_model  # noqa: F401,E402
from lapse.plans import q_scoring  # noqa: F401,E402
from lapse.plans import q_text  # noqa: F401,E402
