"""Column expressions; everything here runs inside the JVM unless it says otherwise."""
