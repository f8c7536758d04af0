"""sources of sparkloom."""
