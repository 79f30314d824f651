"""Registered queries; importing this package registers all of them."""

from codequarry.plans import changes, checks, metadata, scalars, text  # noqa: F401
