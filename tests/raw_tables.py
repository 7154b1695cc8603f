"""Hand-made raw files with the cases that cleaning must handle."""

import os

FILES = {
    "circuits": r''' circuitId , circuitRef ,name,location,country,lat,lng,alt, url
1,monza,"Monza, ""Temple""",Monza,Italy,45.6,9.28,162,/monza
1,monza,"Monza, ""Temple""",Monza,Italy,45.6,9.28,162,/monza
2, spa ,Spa,Stavelot,Belgium,high,5.97,\N,/spa
3,never,Never,Nowhere,None Land,0,0,0,/never
''',
    "constructor_results": r"""constructorResultsId,raceId,constructorId,points,status
1,1,1,43,\N
1,1,1,43,Unknown
2,1,2,ten,D
2,1,2,ten,D
""",
    "constructor_standings": r"""constructorStandingsId,raceId,constructorId,points,position,positionText,wins
1,1,1,43,1, 1 ,1
1,1,1,43,1,1,1
2,1,2,x,2,2,0
""",
    "constructors": r"""constructorId,constructorRef,name,nationality,url
1,red,Red Team, Italian ,/red
1,red,Red Team, Italian ,/red
2,blue,Blue Team,British,/blue
""",
    "driver_standings": r"""driverStandingsId,raceId,driverId,points,position,positionText,wins
1,1,1,25,1,1,1
1,1,1,25,1,1,1
2,1,2,18,x,2,0
""",
    "drivers": r"""driverId,driverRef,number,code,forename,surname,dob,nationality,url
1,alfa,10,ALF,Al,Fa,1970-06-30,Italian,/alfa
1,alfa,10,ALF,Al,Fa,1970-06-30,Italian,/alfa
2,beta,\N,BET, Be ,Ta,not a day,British,/beta
3,gamma,30,GAM,Ga,Mma,1965-01-01,German,/gamma
""",
    "lap_times": r"""raceId,driverId,lap,position,time,milliseconds
1,1,1,1,1:26.572,86572
1,1,1,1,1:26.572,86572
1,1,2,1,1:02:03.4,3723400
1,2,1,2,1:30.000,slow
""",
    "pit_stops": r"""raceId,driverId,stop,lap,time,duration,milliseconds
1,1,1,10,14:05:09,22.5,22500
1,1,1,10,14:05:09,22.5,22500
1,1,2,30,14:45:00,1:02.100,62100
1,2,1,11,25:00:00,30,30000
""",
    "qualifying": r"""qualifyId,raceId,driverId,constructorId,number,position,q1,q2,q3
1,1,1,1,10,1,1:15.106,1:14.706,1:14.306
1,1,1,1,10,1,1:15.106,1:14.706,1:14.306
2,1,2,2,\N,2,1:16.000,\N,
""",
    "races": r"""raceId,year,round,circuitId,name,date,time,url,fp1_date,fp1_time,fp2_date,fp2_time,fp3_date,fp3_time,quali_date,quali_time,sprint_date,sprint_time
1,2000,1,1,First Race,2000-03-12,14:00:00,/1,\N,\N,\N,\N,\N,\N,\N,\N,\N,\N
1,2000,1,1,First Race,2000-03-12,14:00:00,/1,\N,\N,\N,\N,\N,\N,\N,\N,\N,\N
2,2000,2,2,Second Race,2000-99-12,25:00:00,/2,2000-03-24,10:00:00,\N,\N,\N,\N,\N,\N,\N,\N
""",
    "results": r"""resultId,raceId,driverId,constructorId,number,grid,position,positionText,positionOrder,points,laps,time,milliseconds,fastestLap,rank,fastestLapTime,fastestLapSpeed,statusId
1,1,1,1,10,1,1,1,1,10,50,1:34:50.616,5690616,20,1,1:26.572,210.5,1
1,1,1,1,10,1,1,1,1,10,50,1:34:50.616,5690616,20,1,1:26.572,210.5,1
2,1,2,2,\N,2,2,2,2,6,50,+5.478,5696094,21,2,1:27.000,209.1,1
3,1,3,2,30,3,\N,R,3,0,20,\N,\N,\N,\N,\N,\N,99
4,2,1,2,10,2,2,2,2,6,49,+1 Lap,\N,30,1,1:50.5,200.1,1
5,2,2,1,2,1,1,1,1,10,50,25:38.426,1538426,31,2,1:51.0,199.0,1
""",
    "seasons": "year,url\n2000, /2000 \n2000, /2000 \n",
    "sprint_results": r"""resultId,raceId,driverId,constructorId,number,grid,position,positionText,positionOrder,points,laps,time,milliseconds,fastestLap,fastestLapTime,statusId
1,1,1,1,10,1,1,1,1,8,17,25:38.426,1538426,5,1:30.000,1
1,1,1,1,10,1,1,1,1,8,17,25:38.426,1538426,5,1:30.000,1
2,1,2,2,20,2,2,2,2,7,17,+1.430,1539856,6,1:30.500,1
""",
    "status": "statusId,status\n1, Finished \n1, Finished \n2,Did not finish\n",
}


def write(folder) -> str:
    for name, text in FILES.items():
        with open(os.path.join(folder, f"{name}.csv"), "w") as file:
            file.write(text)
    return str(folder)
