"""Further registered queries; importing this package registers all of them."""

from tesserae import catalog  # noqa: F401
from tesserae.queries import answers, pages, relational, retrieval, storage  # noqa: F401
from tesserae.registry import QUERIES, SQL  # noqa: F401
