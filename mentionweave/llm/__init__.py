"""Training-data operators: ten independent DataFrame-to-DataFrame components.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the
library working.
"""
