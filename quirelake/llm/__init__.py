"""Training-data operators. Nothing outside this subpackage imports it.

Workers import these modules, so ship the package with --py-files or PYTHONPATH.
"""
