"""Training-data pipeline operators: scans, sketches, joins, classifiers, packing, archives.

Nothing outside this subpackage imports it; the driver entry adds its queries when it is present.
"""
