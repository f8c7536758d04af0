"""sparkloom: text-corpus and recognition-quality analytics on Spark SQL."""
