"""Tables in the folder that driver and executors share, as the rest of the library writes them."""

from quarry.plans.tables import arrow_rows, drop_path, new_path, shared_dir, written

__all__ = ["arrow_rows", "drop_path", "new_path", "shared_dir", "written"]
