"""beamlake: approximate nearest-neighbour analytics and data preparation on PySpark."""
