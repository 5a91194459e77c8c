"""packetloom: network-security analytics and corpus operators as Spark plans."""
